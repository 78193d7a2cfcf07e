import hashlib
import zlib

import numpy as np
import pytest

from lodefuse.llm import files, media


def plain_feature(payload):
    import math
    from collections import Counter

    n = len(payload)
    mean = sum(payload) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    edges = [i * n // 64 for i in range(65)]
    bits = 0
    for a, b in zip(edges, edges[1:]):
        bits = bits << 1 | (sum(payload[a:b]) / (b - a) > mean)
    return f"mean={mean:.3f};sd={sd:.3f};entropy={entropy:.3f};hash={bits:016x}"


def test_png_round_trip_and_damage():
    for n in (0, 1, 576, 577, 5000):
        payload = media.padded(b"a" * n)
        assert len(payload) % 576 == 0 and len(payload) >= 576
        png = media.encode(payload)
        assert media.decode(png).tobytes() == payload
    with pytest.raises((ValueError, zlib.error)):
        media.decode(png[:60] + bytes([png[60] ^ 1]) + png[61:])


def test_round_trip_through_archives(spark, tmp_path):
    texts = [None, "", "é" * 400, "x" * 100_000, "same", "same", *(f"text {i}" for i in range(300))]
    rows = [(i if i else None, t, b"m") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Media binary").repartition(3)
    path = f"file://{tmp_path}/archives"
    spark.dataSource.register(media.MediaArchive)
    media.as_media(docs).write.format("media_archive").option("path", path).option("archive_bytes", 10_000).mode("append").save()
    assert len(files.committed(path)) > 3
    (tmp_path / "archives" / "left-by-a-lost-executor.zip").write_bytes(b"broken")
    back = spark.read.format("media_archive").option("path", path).option("range_bytes", 7_000).load()
    assert back.rdd.getNumPartitions() > 6
    got = media.described(back).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        r = by[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == plain_feature(payload)


def test_a_member_is_retried_by_itself(tmp_path, monkeypatch):
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    writer = media._Writer(str(tmp_path), 1 << 20)
    import pyarrow as pa

    names = writer.write(iter([pa.RecordBatch.from_pydict({"key": ["1", "2"], "media": [b"one", b"two"]})])).names
    uri = f"{tmp_path}/{names[0]}"
    found = media.directory(uri, (tmp_path / names[0]).stat().st_size)
    asked = []

    def flaky(u, start, n):
        asked.append(start)
        if len(asked) == 1:
            raise OSError("lost")
        data = files.read_at(u, start, n)
        return b"\0" * n if len(asked) == 3 else data

    assert media.member(uri, *found[1][1:], read=flaky) == b"two"
    assert min(asked) >= found[1][1]
    with pytest.raises(ValueError):
        media.member(uri, found[0][1], found[0][2], found[0][3] ^ 1)


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    media.write_media(media.as_media(spark.createDataFrame([], "doc_id long, text string")), path)
    assert media.described(media.read_media(spark, path)).count() == 0
