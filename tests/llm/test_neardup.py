import random

import numpy as np

from lodefuse.llm import neardup, simhash


def sets_of(rows):
    out = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    """doc_ids that stay, by all pairs."""
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                root[of(i)] = of(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(of(i), []).append(rows[i][0])
    return sorted(min((x for x in g if x is not None), default=-1) for g in groups.values())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("abcdefgh")
    line = [word() for _ in range(30)]
    seeds = [[word() for _ in range(rng.randint(20, 300))] for _ in range(12)]
    rows = []
    for i in range(220):
        if i % 3 == 0:
            words = [word() for _ in range(rng.randint(1, 80))]
            words[rng.randrange(len(words)) : 0] = line if i % 2 else []
        else:
            words = list(rng.choice(seeds[:2] if i % 2 else seeds))
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.3:
                words += [word() for _ in range(rng.randint(1, 1 + len(words) // 5))]
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "One"), (303, "one two"), (304, "ONE\ttwo "), (None, "never else seen"), (None, rows[1][1]), rows[4], (4, "another text of row four")]
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark, monkeypatch):
    for seed, few, often in ((1, 16, 4), (2, 2, 100_000)):
        monkeypatch.setattr(neardup, "FEW", few)
        monkeypatch.setattr(neardup, "OFTEN", often)
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, Node string").repartition(3)
        got = neardup.representatives(docs)
        assert got.columns == docs.columns
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == brute(rows)


def test_stage_takes_copies_that_two_bits_miss(spark):
    import corpus_pipeline

    rng = random.Random(9)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((i, " ".join(words)))
        for k in (50, 150, 250):
            words[k] = "other"
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == brute(rows) == list(range(40))
    assert simhash.representatives(docs).count() > 40


def by_sets(sets):
    return lambda q: [k for k in range(len(sets)) if is_alike(sets[q], sets[k])]


def similar(rng, n, size):
    base = rng.integers(0, 1 << 62, size).astype(np.uint64)
    out = [np.unique(np.concatenate([np.delete(base, rng.integers(0, size, int(rng.integers(0, size // 4)))), rng.integers(0, 1 << 62, int(rng.integers(0, size // 6))).astype(np.uint64)])) for _ in range(n)]
    return out + [np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 2 * size))).astype(np.uint64)) for _ in range(n // 2)]


def is_alike(x, y):
    return len(np.intersect1d(x, y)) * 5 >= 4 * len(np.union1d(x, y))


def test_fingerprints_lose_no_alike_sets():
    rng = np.random.default_rng(4)
    for size in (8, 60, 66, 250, 700):
        sets = similar(rng, 60, size)
        sketches, sizes = [neardup.sketch(s) for s in sets], np.array([len(s) for s in sets])
        near = neardup.by_planes(sketches, sizes, lanes=16, worth=size % 4)
        extra = 0
        for q in range(len(sets)):
            want = {k for k in range(len(sets)) if k != q and is_alike(sets[q], sets[k])}
            assert want <= set(near(q))
            extra += len(set(near(q)) - want)
        assert extra < len(sets) * len(sets) / 4


def test_joining_joins_what_all_pairs_join():
    rng = np.random.default_rng(3)
    sets = similar(rng, 40, 100)
    for labels in (np.arange(60), np.arange(60) // 7):
        pairs = neardup.joining(labels, by_sets(sets))
        assert len(neardup.joining(labels, by_sets(sets), 3)) >= len(pairs)
        assert all(is_alike(sets[a], sets[b]) for a, b in pairs)

        def roots(links):
            root = list(range(60))

            def of(i):
                while root[i] != i:
                    i = root[i]
                return i

            for a, b in links:
                root[of(a)] = of(b)
            return [of(i) for i in range(60)]

        same = [(i, j) for i in range(60) for j in range(i) if labels[i] == labels[j]]
        every = [(i, j) for i in range(60) for j in range(i) if is_alike(sets[i], sets[j])]
        one, two = roots(same + pairs), roots(same + every)
        assert all((one[i] == one[j]) == (two[i] == two[j]) for i in range(60) for j in range(i))


def test_a_family_that_one_task_must_not_hold(spark, monkeypatch):
    monkeypatch.setattr(neardup, "STRETCH", 40)
    monkeypatch.setattr(neardup, "LANES", 32)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):  # near the limit of 0.8, so that fingerprints let pairs pass that sets refuse
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(words + [f"tail{i}"] * (i % 3 == 0))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in neardup.representatives(docs).collect()) == brute(rows)


def test_empty(spark):
    assert neardup.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_gives_candidates(spark):
    """The stage's nodes meet by their SimHash: what all pairs of fingerprints link, candidates connect, and no others."""
    rng = np.random.default_rng(8)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 30)]
    fps += [f ^ (1 << int(rng.integers(0, 60))) for f in fps[:20]] + fps[:10]
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp long")
    root = list(range(len(fps)))
    for r in neardup.simhash_pairs(nodes).collect():
        lo, hi = sorted((root[r.a], root[r.b]))
        root = [lo if x == hi else x for x in root]
    group = [i if i < 30 else i - 30 if i < 50 else i - 50 for i in range(len(fps))]
    for i in range(len(fps)):
        assert [root[i] == root[k] for k in range(len(fps))] == [group[i] == group[k] for k in range(len(fps))]
    own = neardup.shingles(b"one two three four five six seven")
    assert 0 < neardup.simhash(own) < 1 << 64


def test_stage_takes_simhash_candidates(spark, monkeypatch):
    """Without the prefix filter's pairs the stage still drops what SimHash finds: its step isn't replaced."""
    met = neardup._met
    monkeypatch.setattr(neardup, "_met", lambda batches: (b.slice(0, 0) for b in met(batches)))
    rng = random.Random(2)
    rows = []
    for i in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(4000)]
        rows += [(i, " ".join(words)), (10 + i, " ".join([*words, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.representatives(docs).collect()) == list(range(6)) == brute(rows)
