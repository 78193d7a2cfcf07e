import hashlib
import random

import numpy as np

from lodefuse.llm import substrings


def brute(rows, window):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, words in docs:
        for i in range(len(words) - window + 1):
            if d is not None:
                key = tuple(words[i : i + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and least[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((-1 if d is None else d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("abcdefgh")
    passages = [[word() for _ in range(rng.randint(window - 3, 2 * window))] for _ in range(4)] + [["x"] * (window + 5), ["x", "y"] * window]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, window))]
            if rng.random() < 0.6:
                p = list(rng.choice(passages))
                if rng.random() < 0.4:
                    p[rng.randrange(len(p))] = word()
                words += p[rng.randint(0, 3) :]
        rows.append((i, " ".join(words) + rng.choice(["", "\n", "\t "])))
    rows += [(n + i, rng.choice(rows)[1]) for i in range(8)]
    rows += [(n + 20, None), (n + 21, ""), (None, rows[0][1]), (None, " ".join(passages[0] * 2)), rows[3], (3, " ".join(passages[1] + passages[0]))]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed, window, gram in ((1, 12, 4), (2, 50, 10)):
        rows = corpus(seed, 60, window)
        docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, Digest string").repartition(3)
        got = substrings.deduplicated(docs, window, gram).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, window)


def test_passage_twice_in_a_document_and_its_anchor_line_in_a_smaller_one(spark):
    window, gram = 12, 4
    rng = random.Random(11)
    rows = []
    word = lambda: f"w{rng.randrange(10**6)}"
    words = lambda n: [word() for _ in range(n)]
    for k in range(40):
        line, before, after = words(6), words(rng.randint(3, 10)), words(rng.randint(3, 10))
        passage, start = before + line + after, words(8)
        one = words(10) + line + words(10)
        two = words(rng.randint(0, 9)) + passage + words(rng.randint(0, 9))
        three = words(3) + start + passage + words(rng.randint(0, 20)) + start + passage + words(2)
        rows += [(3 * k + i, " ".join(x)) for i, x in enumerate((one, two, three))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.deduplicated(docs, window, gram).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, window)


def test_long_documents_in_stretches(monkeypatch):
    words = [b"%d" % (i * i % 97) for i in range(500)]
    whole = [(w, int(g[p])) for _, ws, g, ps in substrings.stretches(words, 20, 5) for w, p in zip(ws.tolist(), ps.tolist(), strict=True)]
    monkeypatch.setattr(substrings, "STRETCH", 64)
    parts = [(w, int(g[p])) for _, ws, g, ps in substrings.stretches(words, 20, 5) for w, p in zip(ws.tolist(), ps.tolist(), strict=True)]
    assert whole == parts and len(whole) == 481


def test_rightmost_of_equals_is_chosen():
    grams = np.array([5, 1, 1, 7, 1, 9], np.uint64) << np.uint64(30)
    assert substrings.chosen(grams, 3).tolist() == [2, 2, 4, 4]


def test_empty(spark):
    assert substrings.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
