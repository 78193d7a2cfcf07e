import random

import numpy as np

from lodefuse.llm import quality


def make(rng, good):
    words = [rng.choice(["river", "stone", "garden", "window", "bread", "music", "letter", "winter", "of", "the"]) for _ in range(rng.randint(3, 90))]
    if not good:
        style = rng.randrange(3)
        words = [w.upper() + "!!" if style == 0 else w + rng.choice(["%%%", "&&&", "###"]) if style == 1 else f"{w} |" for w in words]
    return " ".join(words)


def test_bradley_terry_finds_the_direction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    w = quality.bradley_terry(x, y)
    assert abs(w[0] / w[1] + 2) < 0.5 and abs(w[2]) < 0.3
    one_sided = np.concatenate([np.ones(5), np.zeros(1995)])
    assert np.isfinite(quality.bradley_terry(x, one_sided)).all()


def plain_features(text):
    import math
    import re
    from collections import Counter

    words = text.split()
    if not words:
        return [0.0] * 20
    n, size = len(words), len(text)
    marks, symbols, white = b".,;:?'\"()-", b"#$%&*@^~<>{}[]\\/+=_`", b" \t\n\r\x0b\x0c"
    share = lambda f: sum(map(f, text)) / size
    known = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or 48 <= b <= 57 or b in marks or b in symbols or b in white or b in b"|!"
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b in marks), share(lambda b: b in symbols), share(lambda b: b == 124), share(lambda b: b == 33),
        share(lambda b: b in white), share(lambda b: not known(b)),
        min(sum(map(len, words)) / n / 10, 3.0), sum(len(w) > 14 for w in words) / n, sum(len(w) < 3 for w in words) / n, len(set(words)) / n**0.8, max(Counter(words).values()) / (n + 10),
        1 - len(set(lines)) / len(lines), min(math.log1p(n / len(lines)), 8.0), len(re.findall(rb"[#$%&*@^~!|]{2,}(?=\s|$)", text)) / n, len(re.findall(rb"(?<![a-z])[A-Z]{2,}(?![a-z])", text)) / n,
        -sum(c / size * math.log2(c / size) for c in Counter(text).values()) / 5, math.log1p(n / (1 + len(re.findall(rb"[.!?]+", text)))), math.log1p(n) / 10,
    ]


def test_features_equal_plain_counting():
    rng = random.Random(4)
    texts = [make(rng, i % 2) for i in range(60)] + ["", "É! Ab\nAb\n\nCD... 12|x", "one", "a" * 5000, "\n \t"]
    for t in texts:
        assert np.allclose(quality.features(t.encode()), plain_features(t.encode())), t[:50]


def test_every_row_meets_the_stated_number():
    y = np.array([1.0] * 30 + [0.0] * 7)
    winners, losers = quality.preferences(y)
    assert (y[winners] == 1).all() and (y[losers] == 0).all()
    met = np.bincount(winners, minlength=37) + np.bincount(losers, minlength=37)
    assert met.min() >= quality.PAIRS == 8 and len(winners) == 37 * 8


def test_scores_equal_a_plain_fit(spark):
    """The query's scores again: plain features, gradient steps on the same preferences, a sorted quantile."""
    rng = random.Random(6)
    rows = [(i, make(rng, i % 4 > 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.scores(docs, labels).collect()}
    import zlib

    own = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    wide = lambda f: np.concatenate([f, np.sqrt(np.abs(f)), f * f])
    x = {i: wide(np.array(plain_features(t.encode()))) for i, t in rows}
    a, y = np.array([x[i] for i in own]), np.array([float(i % 4 > 0) for i in own])
    mean, sd = a.mean(0), a.std(0) + 1e-9
    z = (a - mean) / sd
    winners, losers = quality.preferences(y)
    d = z[winners] - z[losers]
    w = np.zeros(d.shape[1])
    for _ in range(400):  # Newton with a fixed small step, no early end
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        grad = d.T @ (p - 1) + 1e-5 * len(d) * w
        w -= 0.5 * np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + (1e-5 * len(d) + 1e-9) * np.eye(len(w)), grad)
    latent = z @ w
    cut = np.sort(latent)
    at = (1 - y.mean()) * (len(cut) - 1)
    cut = cut[int(at)] + (at - int(at)) * (cut[min(int(at) + 1, len(cut) - 1)] - cut[int(at)])
    for i, _ in rows:
        side = ((x[i] - mean) / sd) @ w > cut
        assert abs(((x[i] - mean) / sd) @ w - cut) < 1e-3 * np.abs(latent).max() or (got[i] >= 0.3) == side


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, make(rng, i % 6 > 0)) for i in range(900)]
    edge = [(5000, None), (5001, ""), (None, "a b"), (5002, "x" * 200_000), (5002, "x" * 200_000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows + edge], "doc_id long, text string, X string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(600)], "doc_id long, quality int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == len(rows) + len(edge) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    right = sum((by[i] >= 0.3) == (i % 6 > 0) for i in range(600, 900))
    assert right >= 285, right
    again = {r.doc_id: r.score for r in quality.scores(docs, labels).collect()}
    assert again == by


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.scores(docs, none).collect()] == [0.0]
    assert quality.scores(docs.limit(0), none).count() == 0


def test_rows_beyond_any_sample_are_learned_from(spark):
    """Bars tell bad texts only among labelled rows whose hashed doc_id comes after 12,000 others."""
    from pyspark.sql import functions as F

    from lodefuse.llm import learn

    ids = [r.doc_id for r in spark.range(18_000).toDF("doc_id").where(~learn.held_out()).orderBy(F.xxhash64("doc_id")).collect()]
    assert len(ids) > 13_500
    rng, words = random.Random(8), ["river", "stone", "garden", "window", "bread", "music"]
    text = lambda mark: " ".join(rng.choice(words) + (mark if k % 3 == 0 else "") for k in range(9))
    rows = [(i, text("" if i % 2 else "!" if at < 12_000 else "|"), i % 2) for at, i in enumerate(ids)]
    new = [(10**6 + k, text(("|", "")[k % 2])) for k in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows] + new, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score >= 0.3 for r in quality.scores(docs, labels).collect()}
    assert sum(got[10**6 + k] == bool(k % 2) for k in range(200)) >= 190
    assert abs(sum(got[i] for i in ids) - sum(i % 2 for i in ids)) <= 1


def test_fit_over_blocks_is_that_of_all_their_pairs(spark):
    from lodefuse.llm import learn

    rng = random.Random(9)
    rows = [(i, make(rng, (i % 4 > 0) != (rng.random() < 0.15))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(700)], "doc_id long, quality int")
    model = quality.Model(quality.described(docs), labels, 64)
    blocks = sorted((r.asDict() for r in model.blocks.collect()), key=lambda r: r["block"])
    import zlib

    own = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5]
    assert len(blocks) == -(-len(own) // 64)
    x = quality.expand(np.array([plain_features(rows[i][1].encode()) for i in own]))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-9)
    pairs, home = [], 0
    for block, found, y, at_home in map(quality.unpacked, blocks):
        winners, losers = quality.preferences(y, seed=1 + block)
        turn = 8 * int(y.sum())
        chosen = np.concatenate([winners[:turn], losers[turn:]])
        z = (found - model.mean) / model.scale
        pairs.append((z[winners] - z[losers])[at_home[chosen]])
        home += at_home.sum()
    d = np.concatenate(pairs)
    assert home == len(own) and len(d) == 8 * len(own)
    assert np.allclose(model.weights, learn.logistic(d, np.ones(len(d)), 1e-5), atol=1e-6)
    latent, truth = (x - model.mean) / model.scale @ model.weights, np.array([float(i % 4 > 0) for i in own])
    assert np.isclose(model.cut, np.quantile(latent, 1 - truth.mean()), rtol=0, atol=1e-9)
    assert np.isclose(model.slope, learn.logistic(np.stack([np.ones(len(own)), latent], 1), truth, 1e-6)[1])


def test_rare_class_is_met_in_every_block(spark):
    for held in ([0, 3, 0, 0, 1], [9, 9, 9], [0, 0, 1], [20, 0, 0, 0], [1, 2, 3, 4, 5, 6]):
        n, need = len(held), min(8, sum(held))
        plain = next(k for k in range(1, n + 1) if all(sum(held[(i + j) % n] for j in range(k)) >= need for i in range(n)))
        assert quality.spread(np.array(held)) == plain
    rng = random.Random(10)
    rows = [(i, make(rng, i % 200 == 1)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 200 == 1)) for i in range(600)], "doc_id long, quality int")
    model = quality.Model(quality.described(docs), labels, 50)
    for _, _, y, _ in (quality.unpacked(r.asDict()) for r in model.blocks.collect()):
        assert 0 < y.sum() <= 3 and (y == 0).sum() >= 8
    assert np.isfinite(model.weights).all()


def test_quantile_is_exact(spark):
    rng = np.random.default_rng(11)
    for values in (rng.normal(size=301), rng.integers(-2, 3, 90).astype(float), np.array([-1.5]), np.array([0.0, -3e300, 1e-300, 7.25])):
        found = spark.createDataFrame([(int(k),) for k in quality.keys(values)], "key long")
        for q in (0.0, 0.37, 1.0):
            assert np.isclose(quality.quantile(found, len(values), q), np.quantile(values, q), rtol=1e-12, atol=0), (values, q)
