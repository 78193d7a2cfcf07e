import random
import re
from collections import Counter

import pytest

from lodefuse.llm import mixing


def test_targets_reshare_the_excess():
    got = mixing.targets([10, 1000, 500, 400], [5, 2, 1, 5])
    assert abs(sum(got) - 1.5 * 1910) < 1e-9
    assert got[0] == 20 and got[3] == 800
    assert abs(got[1] / got[2] - 2) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]
    assert mixing.targets([0, 100], [5, 2]) == [0.0, 150.0]


def test_hypergeometric_follows_its_law():
    from math import comb

    rng = random.Random(2)
    n = 40_000
    seen = Counter(mixing.hypergeometric(rng, 7, 12, 9) for _ in range(n))
    for k in range(8):
        want = comb(7, k) * comb(12, 9 - k) / comb(19, 9)
        assert abs(seen[k] / n - want) < 0.01, k
    assert mixing.hypergeometric(rng, 5, 0, 3) == 3 and mixing.hypergeometric(rng, 0, 5, 3) == 0
    assert abs(mixing.hypergeometric(rng, 10**7, 10**7, 10**6) - 5 * 10**5) < 5000


def test_tree_is_exact():
    quotas = [100, 3, 0, 57]
    out = mixing.splitting_tree(quotas, 12, seed=3)
    assert [sum(x) for x in zip(*out, strict=True)] == quotas
    assert max(map(sum, out)) - min(map(sum, out)) <= 4 and len(out) == 12
    assert out == mixing.splitting_tree(quotas, 12, seed=3) != mixing.splitting_tree(quotas, 12, seed=4)


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    rows = [(i, " \t".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "C", "é", None, "zz"])) for i in range(800)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "q " * 5000, "b"), rows[3], rows[3], (None, "x y", "a"), (903, None, "empty"), (904, "\x85  ", "b")]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, source string, Target string").repartition(3)
    return rows, docs, mixing.mix(docs)


def test_sources_meet_their_targets(mixed):
    rows, docs, out = mixed
    got = out.collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, count(t)) for d, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == want[r.source]
        assert 0 <= r.taken <= 2 * r["size"]
        assert sum(x.words for x in r.shards) == r.taken
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 0.5
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_the_mix_holds_the_words(spark, mixed):
    rows, docs, out = mixed
    got = mixing.mixed_documents(docs, out)
    assert got.columns == docs.columns
    got = got.collect()
    words, want = Counter(), Counter()
    for r in got:
        words[r.doc_id, r.source] += count(r.text)
    for r in out.collect():
        if r.taken:
            want[r.doc_id, r.source] += r.taken
    assert words == want
    whole = {}
    for d, t, s in rows:
        whole.setdefault((d, s), []).append(t or "")
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert all(any(split(t)[: count(r.text)] == split(r.text) for t in whole[r.doc_id, r.source]) for r in got)
    assert sum(r.text not in whole[r.doc_id, r.source] for r in got) <= 7  # at most one part a source


def test_shards_are_near_equal(spark, mixed):
    out = mixing.mix(mixed[1], shards=7).collect()
    takings = Counter(x.shard for r in out for x in r.shards)
    assert set(takings) == set(range(7))


def test_shards_below_the_drivers_tree(spark, mixed, monkeypatch):
    monkeypatch.setattr(mixing, "NODES", 4)
    rows, docs, plain = mixed
    out = mixing.mix(docs, shards=22).collect()
    takings = Counter(x.shard for r in out for x in r.shards)
    assert set(takings) <= set(range(24)) and len(takings) >= 22
    assert Counter((r.doc_id, r.source, r.taken) for r in out) == Counter((r.doc_id, r.source, r.taken) for r in plain.collect())
    assert sorted(map(str, mixing.mix(docs, shards=22).collect())) == sorted(map(str, out))


def test_copies_fall_into_many_blocks(spark):
    docs = spark.createDataFrame([(1, "one two three", "a")] * 5000 + [(2, "x " * 100_000, "b")], "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(docs).collect()
    assert len(out) == 5001 and sum(r.taken for r in out if r.source == "a") == round(out[0].target if out[0].source == "a" else next(r.target for r in out if r.source == "a"))
    blocks = Counter(tuple(x.key for x in r.shards) for r in out if r.source == "a")
    assert len(blocks) > 1000  # each copy has places of its own


def test_a_plain_mix_takes_the_same(spark, mixed):
    """The mix again, by lists: sources, blocks in permuted order, the quota from their fronts."""
    import math

    from pyspark.sql import functions as F

    rows, docs, out = mixed
    keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("t"), "text").collect()
    seen, own = Counter(), {}
    for r in keyed:
        k = (r.doc_id, r.source, r.t)
        seen[k] += 1
        own.setdefault(r.source, []).append((*k, seen[k], count(r.text)))
    flat = [(d, s, t, c, n) for s, xs in own.items() for d, s, t, c, n in xs]
    hashed = spark.createDataFrame(flat, "doc_id long, source string, t long, copy long, n long").select("*", F.xxhash64("doc_id", "source", "t", "copy", F.lit(0)).alias("h"), F.xxhash64(F.xxhash64("doc_id", "source", "t", "copy", F.lit(0)), F.lit(3)).alias("inside")).collect()
    by = {}
    for r in hashed:
        by.setdefault(r.source, []).append(r)
    names = sorted(s for s in by if s is not None) + [None]
    sizes = [sum(r.n for r in by[s]) for s in names]
    goal = dict(zip(names, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    want = Counter()
    for s, size in zip(names, sizes, strict=True):
        words = round(goal[s])
        full, quota = (words // size, words % size) if size else (0, 0)
        n = max(1, math.isqrt(len(by[s])))
        blocks = {}
        for r in by[s]:
            blocks.setdefault(r.h % n, []).append(r)
        keys = spark.createDataFrame([(b, s) for b in blocks], "block long, source string").select("block", F.xxhash64("block", "source", F.lit(1)).alias("k")).collect()
        for b in [r.block for r in sorted(keys, key=lambda r: (r.k, r.block))]:
            left = min(quota, sum(r.n for r in blocks[b]))
            quota -= left
            for r in sorted(blocks[b], key=lambda r: (r.inside, -1 if r.doc_id is None else r.doc_id, r.n)):
                part = min(r.n, left)
                left -= part
                want[r.doc_id, s, full * r.n + part] += 1
    assert want == Counter((r.doc_id, r.source, r.taken) for r in out.collect())


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
