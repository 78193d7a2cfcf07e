import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodefuse.llm import winnowing


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def corpus():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice(["", "é", "😀", "xy"])
    rows = [(i * 7 % 301, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(400, None), (401, ""), (402, "one"), (403, "one two"), (404, "same words " * 30), (405, "same words " * 30), (406, "\t \n"), (None, "no id"), (None, "no id either"), (404, "same words " * 30), (404, "another text of the same id")]
    return rows


def python_fingerprint(words, hashes, k, w):
    """Chosen (hash, position) from the words' 64-bit hashes."""
    mask = 2**64 - 1
    rot = lambda x, n: ((x << n) | (x >> (64 - n))) & mask if n else x
    grams = []
    for i in range(max(1, len(words) - k + 1)):
        g = 0
        for j in range(k):
            g ^= rot(hashes[words[i + j]] if i + j < len(words) else 0, k - 1 - j)
        grams.append(g)
    return grams


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, 1) for r in corpus()], "doc_id long, text string, Hashes int").repartition(4)


def test_choice_equals_plain_winnowing(spark, frame):
    import xxhash

    rows = winnowing.fingerprints(frame).collect()
    texts = {}
    for d, t in corpus():
        texts.setdefault(d, []).append(t or "")
    got, want = [], []
    for r in rows:
        got.append((r.doc_id or -1, tuple((e["hash"], e["position"]) for e in r.entries)))
    for d, own in texts.items():
        for t in own:
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            if not words:
                want.append((d or -1, ()))
                continue
            hashes = {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in words}
            grams = [xxhash.xxh64_intdigest(g.to_bytes(8, "little"), 42) >> 32 for g in python_fingerprint(words, hashes, 3, 8)]
            chosen = []
            for i in range(max(1, len(grams) - 7)):
                at = min(range(i, min(i + 8, len(grams))), key=lambda p: (grams[p], -p))
                if not chosen or chosen[-1] != (grams[at], at):
                    chosen.append((grams[at], at))
            want.append((d or -1, tuple(chosen)))
    assert sorted(got) == sorted(want)


def test_shared_runs_share_an_entry(spark):
    rng = random.Random(2)
    run = " ".join(f"w{rng.randrange(500)}" for _ in range(winnowing.WINDOW + winnowing.GRAM - 1))
    texts = [(i, " ".join([*(f"{i}-{j}" for j in range(rng.randint(0, 20))), run, *(f"{i}+{j}" for j in range(rng.randint(0, 20)))])) for i in range(12)]
    got = [{e["hash"] for e in r.entries} for r in winnowing.fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert set.intersection(*got)


def test_query(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 10)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = winnowing.op8_winnowing(spark, str(tmp_path)).collect()
    rows = sorted(corpus(), key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    assert len(got) == len(rows)
    want = []
    for i, (d, t) in enumerate(rows):
        e = edited(t or "", rows[(i + 1) % len(rows)][1] or "")
        want.append((-1 if d is None else d, len(t or ""), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by.setdefault(r.doc_id, []).append(r)
    assert by[405][0].fingerprint in {r.fingerprint for r in by[404]} and len({r.fingerprint for r in by[404]}) == 2
    assert by[405][0].near_next in (0.0, 1.0) and by[401][0].fingerprint == by[400][0].fingerprint == by[406][0].fingerprint
    assert by[401][0].near_next == 1.0
    long = [r for r in got if r.n_chars > 120 and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.9 * len(long)


def test_ranges_follow_the_ids(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 10)
    monkeypatch.setattr(winnowing, "QUANTILES", 4)
    rng = random.Random(3)
    ids = [*range(100), *(rng.randrange(10**15) for _ in range(100)), -(2**62), 2**62, 5, 5, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = df.withColumn("b", winnowing._ranges(df)).collect()
    known = sorted((r.doc_id, r.b) for r in got if r.doc_id is not None)
    assert [b for _, b in known] == sorted(b for _, b in known) and len({b for _, b in known}) > 8
    assert [r.b for r in got if r.doc_id is None] == [-1]


def test_many_repeated_rows_and_a_long_text(spark, tmp_path):
    rows = [(7, "again and again")] * 3000 + [(8, "w " * 60_000 + "end"), (6, "six words are in this text"), (None, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = winnowing.op8_winnowing(spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want = [hashlib.sha256(edited(t or "", order[(i + 1) % len(order)][1] or "").encode()).hexdigest() for i, (_, t) in enumerate(order)]
    assert sorted(r.edited_sha256 for r in got) == sorted(want)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 7) == 2999


def test_single_row_and_none(spark, tmp_path):
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    one.write.parquet(f"{tmp_path}/documents.parquet")
    r = winnowing.op8_winnowing(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].near_next == 1.0 and r[0].edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    one.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    assert winnowing.op8_winnowing(spark, f"{tmp_path}/none").count() == 0
