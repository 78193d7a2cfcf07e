import hashlib
import io

import pytest

from lodefuse.llm import files, warc


def test_bundle_random_access_and_plain_zstd():
    out = io.BytesIO()
    writer = warc.BundleWriter(out, frame_bytes=500)
    rows = {}
    for i in range(50):
        body = (f"<p>{i}</p>" * (i + 1)).encode()
        digest = hashlib.sha1(body).hexdigest()
        rows[i] = (body, digest)
        writer.add(i, warc.record(i, f"http://x/{i}\r\nEvil: 1 %0A", body, len(body), digest, "response", None))
    writer.close()
    data = out.getvalue()
    asked = []

    def read(start, n):
        asked.append(n)
        return data[start : start + n]

    bundle = warc.Bundle(read, len(data))
    assert len(bundle.frames) > 5
    for i in (0, 17, 49):
        got = bundle.record(i)
        assert got["payload"] == rows[i][0] and got["payload_digest"] == rows[i][1] and got["url"] == f"http://x/{i}%0D%0AEvil: 1 %0A"
    assert max(asked) < len(data) / 2
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 50  # any reader that skips skippable frames


def test_urls_are_written_as_they_are():
    url = "http://x/a%20b?q=%25&z=é"
    data = warc.record(1, url, b"p", 1, hashlib.sha1(b"p").hexdigest(), "response", None)
    assert f"WARC-Target-URI: {url}\r\n".encode() in data
    assert warc.parsed(data)[0]["url"] == url


def test_a_very_long_payload(spark, tmp_path):
    long = "long text " * 500_000
    path = f"file://{tmp_path}/long"
    warc.write_bundles(warc.records(spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "x")], "page_id long, url string, html string")), path)
    got = {r.page_id: r for r in warc.read_bundles(spark, path).collect()}
    assert got[2].payload.decode() == long and got[1].refers_to == 2 and got[1].payload_bytes == len(long) and got[3].record_type == "response"


def test_damage_is_found():
    data = warc.record(1, None, b"abc", 3, hashlib.sha1(b"abd").hexdigest(), "response", None)
    with pytest.raises(ValueError):
        warc.parsed(data)


def test_pages(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u", big), (2, "u", big), (9, None, big), (9, "u", big), (None, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 1000), (8, "u", "y" * 3000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, Payload int").repartition(2)
    path = f"file://{tmp_path}/warc"
    warc.write_bundles(warc.records(pages), path, frame_bytes=300, bundle_bytes=300)
    assert len(files.committed(path)) > 1
    got = warc.read_bundles(spark, path, range_bytes=64).collect()
    assert len(got) == len(rows)
    seen = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page_id != 9
        want.append((page_id or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert seen == sorted(want)
    assert {r.url for r in got} == {"u", None}


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_bundles(warc.records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.read_bundles(spark, path).count() == 0
