"""Toxicity by noisy-channel deobfuscation.

Written words are taken as noisy spellings: symbols and digits for letters, letters drawn out
or doubled, words spaced or dotted out letter by letter. Each becomes a lattice of the letters
that each place may stand for, with channel costs, and Viterbi finds the cheapest path under a
character trigram model counted over the whole corpus. Every word with a letter whose lattice
has more than one path is decoded, wherever the symbol or the doubled letter stands; any other
word is its own decoding. Words are decoded once, as long as a worker remembers them.

Restored words are scored by character n-grams (word-bounded) that labelled documents tell
apart, and documents by a logistic regression over what those words add up to. N-gram
weights come from the labelled sample, and the regression from its halves, each described by
weights of the other.

The sample is bounded by ``learn.SAMPLE_ROWS``, and with it the n-grams that show evidence, all
of which are kept; the language model counts all documents (32**3 trigram counts travel).

Edge cases: null and empty texts get the score of a text without signals; without labels of
both classes every score is the known share of label 1, or 0; repeated rows score alike; very
long texts and words are decoded whole; of equally cheap readings the first listed holds; an
empty table gives no rows; a null doc_id is held out of nothing and scored as any other.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefuse.llm import learn
from lodefuse.llm.common import parts, saved, slim, table, texts

#: Letters of the language model: word boundary, a to z, any other letter.
BOUNDARY, OTHER, ALPHABET = 0, 27, 32
#: Words that a worker remembers, and how long they may be.
REMEMBER, LONGEST = 150_000, 64
#: Documents of half the sample that must have an n-gram for its weight there.
SUPPORT = 2
#: Evidence (twice a log likelihood ratio) that an n-gram must exceed: chance reaches it once in some hundred thousand.
EVIDENCE = 20.0
#: Log ratio that an n-gram must exceed.
MIN_WEIGHT = math.log(8)
N = 5
THRESHOLD = 0.5

#: What a symbol may stand for, besides nothing.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "&": "a", "%": "o"}
#: Symbols that often close a word and mean nothing then.
CLOSING = "!*#%&|"
#: Costs, in nats, of a symbol for a letter, of dropping a letter of a run, and of a separator or closing mark.
SUBSTITUTE, DROP, SEPARATE = 1.0, 0.4, 0.2

_LETTER = r"[^\W\d_]"
_SYMBOL = "[" + re.escape("".join(READINGS)) + "]"
#: What gives a lattice a second path.
_MANY = re.compile(rf"{_SYMBOL}|({_LETTER})\1")
_HAS = re.compile(_LETTER)
_SPOT = re.compile(rf"({_SYMBOL})\1*|({_LETTER})\2+")
_RUN = re.compile(r"(.)\1*", re.S)
#: Three or more single letters (or symbols), apart by spaces or marks.
_SPACED = re.compile(rf"(?<![^\W_])(?:{_LETTER}|{_SYMBOL})(?:(?:[^\w\n]|_){{1,3}}(?:{_LETTER}|{_SYMBOL})){{2,}}(?![^\W_])")
_WORD = re.compile(r"[^\s.,;:\"'?…»«]+")
_FOLD = {c: b for group, b in (("àáâãäåā", "a"), ("çćč", "c"), ("èéêëē", "e"), ("ìíîïī", "i"), ("ñń", "n"), ("òóôõöøō", "o"), ("ùúûüū", "u"), ("ýÿ", "y")) for c in group}


def _classes() -> np.ndarray:
    """Class by code point below 0x250 of the language model's alphabet."""
    out = np.zeros(0x250, np.uint8)
    for i in range(0x250):
        c = _FOLD.get(chr(i).lower(), chr(i).lower())
        out[i] = ord(c) - 96 if "a" <= c <= "z" and len(c) == 1 else OTHER if c.isalpha() else BOUNDARY
    return out


_CLASS = _classes()


_CODES = {chr(i): int(x) for i, x in enumerate(_CLASS)}


def letter(c: str) -> int:
    return int(_CLASS[ord(c)]) if ord(c) < 0x250 else OTHER if c.isalpha() else BOUNDARY


def trigrams(text: str) -> np.ndarray:
    """Codes of the text's class trigrams that end in a letter or a first boundary."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 0x250
    own = np.full(len(codes) + 3, BOUNDARY, np.int32)
    own[2:-1] = np.where(low, _CLASS[np.where(low, codes, 0)], OTHER)
    a, b, c = own[:-2], own[1:-1], own[2:]
    keep = (c != BOUNDARY) | (b != BOUNDARY)
    return ((np.where(b == BOUNDARY, BOUNDARY, a) * ALPHABET + b) * ALPHABET + c)[keep]


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities (32, 32, 32) of a class after two others, from all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ALPHABET**3, np.int64)
        for batch in parts(batches, 1 << 18):
            counts += np.bincount(trigrams(" ".join(t.decode("utf-8", "replace") for t in texts(batch))), minlength=ALPHABET**3)
        codes = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts[codes])], names=["code", "n"])

    rows = slim(docs, "text").mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most 32**3
    counts = np.zeros(ALPHABET**3)
    for r in rows:
        counts[r["code"]] = r["n"]
    return smoothed(counts)


def smoothed(counts: np.ndarray) -> np.ndarray:
    three = counts.reshape(ALPHABET, ALPHABET, ALPHABET) + 0.0
    two, one = three.sum(0) + 0.1, three.sum((0, 1)) + 1.0
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log((three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5))


def _symbol(c: str, run: int, closing: bool) -> list[tuple[str, float]]:
    """What a run of a symbol may stand for."""
    reads = [(x, SUBSTITUTE + DROP * (run > 1)) for x in READINGS[c]] + [("", SEPARATE if closing else 2 * SUBSTITUTE)]
    return reads + ([(2 * x, SUBSTITUTE + DROP * (run > 2)) for x in READINGS[c]] if run > 1 else [])


def _letters(c: str, run: int) -> list[tuple[str, float]]:
    """What a run of a letter may stand for."""
    return [(c, DROP * (run > 1))] + ([(c * 2, DROP * (run > 2))] if run > 1 else [])


def lattice(word: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """For each place of a word, (letters, cost) it may stand for; letters may be empty. A stretch without choice is one place."""
    places: list[list[tuple[str, float]]] = []
    at = 0
    if spaced:
        for m in _RUN.finditer(word):
            c, run = m[0][0], len(m[0])
            places.append(_letters(c, run) if c.isalpha() else _symbol(c, run, False) if c in READINGS and c != "*" else [("", SEPARATE)])
        return places
    body = len(word.rstrip(CLOSING))
    for m in _SPOT.finditer(word):
        if m.start() > at:
            places.append([(word[at : m.start()], 0.0)])
        c, run, at = m[0][0], len(m[0]), m.end()
        places.append(_symbol(c, run, m.start() >= body) if c in READINGS else _letters(c, run))
    return places + ([[(word[at:], 0.0)]] if at < len(word) else [])


def costs(model: np.ndarray) -> list[float]:
    """A trigram model's costs by code (a * 32 + b) * 32 + c; a boundary after a boundary costs nothing."""
    own = -model
    own[:, BOUNDARY] = own[BOUNDARY, BOUNDARY]
    own[:, BOUNDARY, BOUNDARY] = 0.0
    return own.ravel().tolist()


def viterbi(places: list[list[tuple[str, float]]], cost: list[float]) -> str:
    """The cheapest reading of a lattice under the trigram costs; ties go to the first reading listed."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the last two classes
    for options in places:
        step: dict[int, tuple[float, tuple | None]] = {}
        for start, (before, back) in states.items():
            for letters, extra in options:
                key, total = start, before + extra
                for c in letters:
                    code = key << 5 | (_CODES[c] if c in _CODES else letter(c))
                    total += cost[code]
                    key = code & 1023
                if key not in step or total < step[key][0]:
                    step[key] = (total, (letters, back) if letters else back)
        states = step
    best = min(states.items(), key=lambda s: s[1][0] + cost[s[0] << 5])[1][1]
    out = []
    while best is not None:
        out.append(best[0])
        best = best[1]
    return "".join(reversed(out))


def ambiguous(word: str) -> bool:
    """Whether a word's lattice has more than one path; without any letter it isn't taken as a word."""
    return bool(_MANY.search(word)) and bool(_HAS.search(word))


class Restorer:
    """Restores words of lower-cased texts."""

    def __init__(self, model: np.ndarray):
        self.cost = costs(model)

    def _reading(self, m: re.Match) -> str:
        return viterbi(lattice(m[0]), self.cost) if ambiguous(m[0]) else m[0]

    def _joined(self, m: re.Match) -> str:
        return f" {viterbi(lattice(m[0], True), self.cost)} " if _HAS.search(m[0]) else m[0]

    def word(self, written: str) -> str:
        """What stands between white space, its words restored."""
        if not ambiguous(written):
            return written
        return viterbi(lattice(written), self.cost) if _WORD.fullmatch(written) else _WORD.sub(self._reading, written)

    def tokens(self, text: str) -> list[str]:
        """A text's written words, lower-cased, spaced-out ones joined and read."""
        text = text.lower()
        if _SPACED.search(text):
            text = _SPACED.sub(self._joined, text)
        return text.split()

    def text(self, text: str) -> str:
        """The text lower-cased and restored, a space between words."""
        return " ".join(self.word(w) for w in self.tokens(text))


def grams(word: str, n: int = N) -> list[str]:
    """Word-bounded n-grams of a word, and shorter words whole."""
    w = f"^{word}$"
    return [w] if len(w) <= n else [w[i : i + n] for i in range(len(w) - n + 1)]


_TRIM = "!?.,;:\"'()[]{}|*#$%&…»«-+=/\\<>~`^_"


def words(text: str) -> list[str]:
    return [w for w in (x.strip(_TRIM) for x in text.split()) if w]


class Remembered:
    """A function of written words whose values are kept for up to REMEMBER of them."""

    def __init__(self, of):
        self.of, self.known = of, {}

    def all(self, words: list[str]) -> list:
        """The function's values, none of which is None."""
        found = list(map(self.known.get, words))
        if None in found:
            for i, word in enumerate(words):
                if found[i] is None:
                    found[i] = self._made(word)
        return found

    def _made(self, word: str):
        value = self.known.get(word)
        if value is None:
            value = self.of(word)
            if len(word) <= LONGEST:
                if len(self.known) >= REMEMBER:
                    self.known.clear()
                self.known[word] = value
        return value


class Scorer:
    """What a text's restored words add up to under n-gram weights."""

    def __init__(self, weights: dict[str, float], restorer: Restorer):
        self.weights, self.restorer, self.value = weights, restorer, Remembered(self._word)

    def _word(self, written: str) -> float:
        return max((v for w in words(self.restorer.word(written)) for v in map(self.weights.get, grams(w)) if v), default=0.0)

    def features(self, text: str) -> list[float]:
        values = self.value.all(self.restorer.tokens(text))
        hits = list(filter(None, values))
        total = sum(hits)
        return [1.0, max(hits, default=0.0), math.log1p(total), total / (len(values) + 20)]


def _weight(pos, neg, all_pos: float, all_neg: float, log):
    """Log ratio of an n-gram's smoothed shares of positive and negative documents."""
    return log((pos + 0.5) / (all_pos + 1)) - log((neg + 0.5) / (all_neg + 1))


def _evidence(pos: Column, neg: Column, all_pos: float, all_neg: float) -> Column:
    """Twice the log likelihood ratio of an n-gram's documents against chance: rare n-grams that meet a label by luck stay low."""
    share, n = all_pos / (all_pos + all_neg), pos + neg
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return 2 * (part(pos, share) + part(neg, 1 - share))


def _gram_counts(model: np.ndarray):
    """(gram, half, positive, negative) numbers of documents, per task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        of = Remembered(lambda written: tuple({g for w in words(restorer.word(written)) for g in grams(w)}))
        for batch in parts(batches, 16 << 20):
            counts: dict[tuple[str, int], list[int]] = {}
            for text, y, half in zip(texts(batch), batch.column("y").to_pylist(), batch.column("half").to_pylist(), strict=True):
                found: set[str] = set()
                found.update(*of.all([*set(restorer.tokens(text.decode("utf-8", "replace")))]))
                for g in found:
                    counts.setdefault((g, half), [0, 0])[int(y)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in counts], pa.string()), pa.array([h for _, h in counts], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["gram", "half", "pos", "neg"])

    return counted


def _scored(model: np.ndarray, weights: dict[str, float], coefficients: list[float] | None, constant: float):
    """Appends features (to fit) or scores to batches of doc_id and text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, Restorer(model))
        for batch in parts(batches):
            own = [scorer.features(t.decode("utf-8", "replace")) for t in texts(batch)]
            if coefficients is None:
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(own, pa.list_(pa.float64()))], names=["y", "x"])
            else:
                score = learn.sigmoid(np.array(own).reshape(len(own), -1) @ np.array(coefficients)) if coefficients else np.full(len(own), constant)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return made


class Model:
    """A fitted toxicity model: language model, n-gram weights and regression."""

    def __init__(self, docs: DataFrame, labels: DataFrame, rows: int = learn.SAMPLE_ROWS):
        docs = slim(docs, "doc_id", "text")
        self.language = language_model(docs)
        self.weights: dict[str, float] = {}
        self.coefficients: list[float] = []
        chosen = learn.sample(labels, "toxic", rows)
        own = saved(docs.join(F.broadcast(chosen), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), "sample")
        share = own.agg(F.avg("y").alias("share"), F.count("*").alias("n")).first()
        self.share = share["share"] or 0.0
        if not 0 < self.share < 1:
            return
        counts = own.select("text", "y", "half").mapInArrow(_gram_counts(self.language), "gram string, half long, pos long, neg long")
        sums = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("pos", "neg")]
        n = {(r["half"], r["y"]): r["count"] for r in own.groupBy("half", "y").count().collect()}
        pos, neg = ([n.get((h, y), 0) for h in (0, 1)] for y in (1.0, 0.0))
        both = F.col("pos0") + F.col("pos1"), F.col("neg0") + F.col("neg1")
        best = counts.groupBy("gram").agg(*sums).withColumn("w", _weight(*both, sum(pos), sum(neg), F.log)).where((F.col("w") > MIN_WEIGHT) & (_evidence(*both, sum(pos), sum(neg)) > EVIDENCE)).orderBy("gram").collect()
        self.weights = {r["gram"]: float(r["w"]) for r in best}
        # each half is described by weights of the other, so that the regression sees what new documents look like
        halves = []
        for h in (0, 1):
            o = 1 - h
            own_w = {r["gram"]: _weight(r[f"pos{o}"], r[f"neg{o}"], pos[o], neg[o], math.log) for r in best if r[f"pos{o}"] >= SUPPORT}
            own_w = {g: w for g, w in own_w.items() if w > MIN_WEIGHT}
            halves += own.where(F.col("half") == h).select("text", "y").mapInArrow(_scored(self.language, own_w, None, 0.0), "y double, x array<double>").collect()
        self.coefficients = learn.logistic(np.array([r["x"] for r in halves]), np.array([r["y"] for r in halves]), 1e-4).tolist()

    def scores(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every document."""
        return slim(docs, "doc_id", "text").mapInArrow(_scored(self.language, self.weights, self.coefficients, self.share), "doc_id long, score double")

    def keep(self, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """The rows of docs, all columns as they are, that score below the threshold."""
        scored = _scored(self.language, self.weights, self.coefficients, self.share)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two = itertools.tee(parts(batches))
            for batch, made in zip(one, scored(two), strict=True):
                yield batch.filter(pc.less(made.column("score"), threshold))

        # numbered columns inside: mapInArrow looks them up by names, and takes a point in one for a path
        names = [c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)]
        inside = docs.toDF(*names)
        return inside.mapInArrow(kept, inside.schema).toDF(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = Model(docs, table(spark, sf_dir, "labels")).scores(docs)
    return scores.select("doc_id", learn.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
