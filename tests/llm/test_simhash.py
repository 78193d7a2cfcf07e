import random

import numpy as np

from lodefuse.llm import simhash
from lodefuse.llm.components import components


def brute_components(fps):
    left, out = set(range(len(fps))), {}
    while left:
        root = min(left)
        queue = [root]
        left.discard(root)
        while queue:
            i = queue.pop()
            out[i] = root
            for j in [j for j in left if bin(fps[i] ^ fps[j]).count("1") <= 2]:
                left.discard(j)
                queue.append(j)
    return out


def chained(rng, n):
    fps = {rng.getrandbits(64)}
    while len(fps) < n:
        x = rng.choice(sorted(fps)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    return sorted(fps)


def test_near_equals_popcount():
    rng = random.Random(3)
    fps = chained(rng, 300)
    block = simhash.Planes(np.array(fps, np.uint64).view(np.uint8).reshape(-1, 8))
    for q in fps[:50]:
        got = block.near(q, block.all)
        assert got == sum(1 << i for i, x in enumerate(fps) if bin(x ^ q).count("1") <= 2)


def test_forest_over_several_blocks():
    fps = chained(random.Random(4), 400)
    roots = {m: r for r, m in simhash.forest(np.array(fps, np.uint64), lanes=64)}
    assert {i: roots.get(i, i) for i in range(len(fps))} == brute_components(fps)


def test_links_with_and_without_split(spark):
    fps = chained(random.Random(5), 250)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, node long")
    for split in (2048, 2):
        found = {r.node: r.component for r in components(simhash.links(df, split)).collect()}
        assert {i: found.get(i, i) for i in range(len(fps))} == brute_components(fps)


def test_a_dense_family_is_split_into_block_pairs(spark):
    rng = random.Random(11)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(900)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, node long")
    found = {r.node: r.component for r in components(simhash.links(df, 64, 16)).collect()}
    assert {i: found.get(i, i) for i in range(len(fps))} == brute_components(fps)


def test_a_very_long_text(spark):
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, long + " "), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] == (brute_fp(long), 1) and got[3][1] == 3


def brute_fp(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("Alpha beta gamma DELTA é ñ x1 y".split(" ")) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one"), (103, "one two"), (104, "One TWO"), (None, "one two"), (None, "never else seen here at all"), (104, "One TWO")]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, FP string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = [brute_fp(t) for _, t in rows]
    assert sorted((r.doc_id or -1, r.fp & (2**64 - 1)) for r in got) == sorted((d or -1, f) for (d, _), f in zip(rows, want, strict=True))
    roots, ids = brute_components(want), {}
    for i, r in roots.items():
        ids.setdefault(r, []).append(rows[i][0])
    component = {}
    for i, r in roots.items():
        component[rows[i][0]] = min([x for x in ids[r] if x is not None], default=None)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == component[r.doc_id]
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["103", "None"]


def test_representatives(spark):
    rows = [(5, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (None, "a b c d", "z"), (None, "only here it is", "z"), (None, "only here it is", "w"), (9, None, "n"), (8, "", "n"), (7, "quite another text", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == [(-1, "only here it is"), (2, "a b c d"), (7, "quite another text"), (8, "")]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
