import itertools
import math
import random

import numpy as np
import pytest

from lodefuse.llm import learn, toxicity


def make(rng, toxic, noisy=False):
    words = [rng.choice(["river", "stone", "garden", "window", "bread", "music", "letter", "winter"]) for _ in range(rng.randint(5, 60))]
    if toxic:
        for _ in range(2):
            word = rng.choice(["scoundrel", "blockhead"])
            if noisy:
                word = rng.choice([word.replace("o", "0").replace("e", "3"), " ".join(word), word.replace("c", "cccc").replace("o", "oooo"), ".".join(word)])
            words.insert(rng.randrange(len(words)), word)
    return " ".join(words)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(7)
    rows = [(i, make(rng, i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, Score double").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(500)], "doc_id long, toxic int")
    return toxicity.Model(docs, labels)


def brute(places, model):
    best = None
    for path in itertools.product(*places):
        read = "".join(x for x, _ in path)
        cost, a, b = sum(c for _, c in path), 0, 0
        for c in read:
            z = toxicity.letter(c)
            cost -= float(model[a if b else 0, b, z]) * bool(b or z)
            a, b = b, z
        cost -= float(model[a if b else 0, b, 0]) * bool(b)
        if best is None or cost < best[0] - 1e-12:
            best = (cost, read)
    return best


def test_viterbi_is_the_cheapest_path(fitted):
    for word in ("st0ne", "wwinnter", "br3@d", "mu$1c", "l|77er", "gg4rdenn", "!diot", "a$$", "fuuck", "st0ne!!", "letter", "w-1nd0w"):
        places = toxicity.lattice(word)
        cost, read = brute(places, fitted.language)
        assert toxicity.viterbi(places, toxicity.costs(fitted.language)) == read


def test_trigram_counts_equal_plain_counting():
    text = "Été, a bb ccc?"
    codes = [0, 0] + [toxicity.letter(c) for c in text] + [0]
    want = []
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if c or b:
            want.append(((a if b else 0) * 32 + b) * 32 + c)
    assert toxicity.trigrams(text).tolist() == want
    total = np.exp(toxicity.smoothed(np.ones(32**3)))
    assert np.allclose(total.sum(2), 1)


def test_restores_leetspeak_spacing_and_repetition(fitted):
    r = toxicity.Restorer(fitted.language)
    assert r.text("a sc0undr3l in the g4rden") == "a scoundrel in the garden"
    assert "blockhead" in r.text("you b l o c k h e a d now")
    assert "blockhead" in r.text("you bbbblockhead now")
    assert r.text("Plain words stay!") == "plain words stay"  # a closing mark is read as nothing


def test_every_word_with_a_second_path_is_decoded(fitted):
    rng = random.Random(2)
    forms = ["!diot", "|diot", "+wat", "a$$", "as$", "fuuck", "letter", "plain", "don-t", "2024", "5th", "$", "stop!", "ünd", "a_b", "idiiot"]
    forms += ["".join(rng.choice("aab0$!-|éß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    for w in forms:
        many = any(len(options) > 1 for options in toxicity.lattice(w))
        assert toxicity.ambiguous(w) == (many and any(c.isalpha() for c in w)), w
        if not many:
            assert "".join(x for options in toxicity.lattice(w) for x, _ in options) == w


def test_spellings_reach_their_words():
    rng = random.Random(1)
    pool = ["idiot", "idiots", "twat", "ass", "fuck", "river", "stone", "garden", "was", "diet"]
    model = toxicity.smoothed(sum(np.bincount(toxicity.trigrams(rng.choice(pool)), minlength=32**3) for _ in range(2000)).astype(float))
    r = toxicity.Restorer(model)
    got = {w: r.text(w) for w in ("!diot", "|diot", "+wat", "a$$", "fuuck", "idiiot", "a s s", "f/u/c/k", "1d10t", "river!", "garden*")}
    assert got == {"!diot": "idiot", "|diot": "idiot", "+wat": "twat", "a$$": "ass", "fuuck": "fuck", "idiiot": "idiot", "a s s": "ass", "f/u/c/k": "fuck", "1d10t": "idiot", "river!": "river", "garden*": "garden"}


def test_weights_and_scores_against_plain_counting(spark):
    rng = random.Random(5)
    rows = [(i, make(rng, i % 3 == 0, noisy=i % 6 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.Model(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    restorer = toxicity.Restorer(model.language)
    learned = [(i, t) for i, t in rows if toxicity_crc(i) % 5]
    n, seen = [0, 0], {}
    for i, t in learned:
        y = int(i % 3 == 0)
        n[y] += 1
        for g in {g for w in toxicity.words(restorer.text(t)) for g in toxicity.grams(w)}:
            seen.setdefault(g, [0, 0])[y] += 1
    share, want = n[1] / sum(n), {}
    for g, (neg, pos) in seen.items():
        w = math.log((pos + 0.5) / (n[1] + 1)) - math.log((neg + 0.5) / (n[0] + 1))
        told = 2 * sum(k * math.log(k / ((pos + neg) * p)) for k, p in ((pos, share), (neg, 1 - share)) if k)
        if w > toxicity.MIN_WEIGHT and told > toxicity.EVIDENCE:
            want[g] = w
    assert set(want) == set(model.weights) and want
    assert all(abs(model.weights[g] - w) < 1e-9 for g, w in want.items())
    got = {r.doc_id: r.score for r in model.scores(docs).collect()}
    for i, t in rows:
        own = restorer.text(t).split()
        hits = [v for v in (max((want.get(g, 0.0) for x in toxicity.words(w) for g in toxicity.grams(x)), default=0.0) for w in own) if v]
        x = [1.0, max(hits, default=0.0), math.log1p(sum(hits)), sum(hits) / (len(own) + 20)]
        assert abs(got[i] - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.coefficients, strict=True))))) < 1e-9


def toxicity_crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


def test_held_out_and_noisy_accuracy(spark, fitted):
    rng = random.Random(8)
    rows = [(10_000 + i, make(rng, i % 2 == 0, noisy=i % 4 == 0), i % 2 == 0) for i in range(200)]
    got = {r.doc_id: r.score for r in fitted.scores(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    right = sum((got[d] >= 0.5) == y for d, _, y in rows)
    assert right >= 190, right


def test_edge_rows(spark, fitted):
    rows = [(1, None), (2, ""), (None, "scoundrel blockhead"), (3, "x" * 100_000), (3, "x" * 100_000), (4, "1 2 3 4 5 6 7 8 $ @ !"), (5, "日本語 €¡£ ퟿")]
    got = fitted.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] < 0.5 < by[None]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.Model(docs, none).scores(docs).collect()] == [0.0]
    assert toxicity.Model(docs.limit(0), none).scores(docs.limit(0)).count() == 0


def test_held_out_rows_are_never_learned(spark):
    import zlib

    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    got = [r.doc_id for r in learn.sample(labels, "toxic").collect()]
    assert got and all(zlib.crc32(str(i).encode()) % 5 for i in got)
    assert len(learn.sample(labels, "toxic", 10).collect()) == 10
