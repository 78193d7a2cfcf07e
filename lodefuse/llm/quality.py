"""Quality by Bradley-Terry pairwise ranking.

A document's latent score is linear in its features; of a preferred and another document the
first wins with the logistic of the score difference, so the weights are those of a logistic
regression on feature differences, without intercept. Every labelled document outside the
held-out ones takes part and meets ``PAIRS`` of the other class. Labelled documents are dealt to blocks by
their hashed doc_id, and pairs are made within blocks; the fit goes by sums over all blocks, of which the driver gets one
row a block in each step. The fit starts from that of one block, which changes the number of steps only.
The threshold is the exact quantile of all labelled documents' latent scores at their share of unpreferred
documents (part of the fit, since the share is known of labelled documents only); scores are moved and scaled monotonically so that it lies at 0.3.

Features are shares and means over a whole text, so length by itself says little.

Edge cases: null and empty texts have all features zero but the intercept-free score is
still defined; very long texts are described whole; of a labelled id's texts the one whose
features come first is learned from; without labels of both classes every score is the share of label 1, or 0;
ties share a score; repeated rows score alike; an empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefuse.llm import learn
from lodefuse.llm.common import parts, saved, slim, table, texts

THRESHOLD = 0.3
PAIRS = 8
#: Labelled rows of a block, about, which a worker holds; pairs that it holds at once.
BLOCK, ONCE = 8192, 8192
RIDGE = 1e-5
NAMES = ["upper", "digit", "mark", "symbol", "bar", "bang", "space", "other", "word_length", "long_words", "short_words", "distinct", "top_word", "lines_again", "line_length", "marked_words", "caps_words", "entropy", "sentence_length", "size"]

_KIND = np.zeros(256, np.int64)  # 0: the rest
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"#$%&*@^~<>{}[]\\/+=_`", b"|", b"!", b" \t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz"), 1):
    _KIND[list(_chars)] = _k
_MARKED = re.compile(rb"[#$%&*@^~!|]{2,}(?=\s|$)")
_CAPS = re.compile(rb"(?<![a-z])[A-Z]{2,}(?![a-z])")
_END = re.compile(rb"[.!?]+")


def features(text: bytes) -> list[float]:
    """NAMES of one UTF-8 text."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=9) / len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    times = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = counts[counts > 0] / len(text)
    return [
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[0],
        min(float(lengths.mean()) / 10, 3.0),
        float((lengths > 14).mean()),
        float((lengths < 3).mean()),
        len(times) / n**0.8,
        max(times.values()) / (n + 10),
        1 - len(set(lines)) / len(lines),
        min(float(np.log1p(n / len(lines))), 8.0),
        len(_MARKED.findall(text)) / n,
        len(_CAPS.findall(text)) / n,
        float(-(share * np.log2(share)).sum()) / 5,
        float(np.log1p(n / (1 + len(_END.findall(text))))),
        float(np.log1p(n)) / 10,
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their roots (small shares matter) and squares."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=1)


def preferences(y: np.ndarray, pairs: int = PAIRS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(winners, losers): each row meets `pairs` rows of the other class, in shuffled rounds."""
    rng = np.random.default_rng(seed)
    classes = np.flatnonzero(y == 1), np.flatnonzero(y == 0)

    def met(own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(own) * pairs
        return np.tile(own, pairs), np.concatenate([rng.permutation(others) for _ in range(-(-n // len(others)))])[:n]

    (a, b), (d, c) = met(*classes), met(*classes[::-1])
    return np.concatenate([a, c]), np.concatenate([b, d])


def beaten(x: np.ndarray, y: np.ndarray, home: np.ndarray, w: np.ndarray, pairs: int = PAIRS, seed: int = 1) -> np.ndarray:
    """`learn.sums` at w over the differences of preferences; rows that aren't at home are met, but meet none themselves."""
    winners, losers = preferences(y, pairs, seed)
    turn = pairs * int((y == 1).sum())
    own = home[np.concatenate([winners[:turn], losers[turn:]])]
    winners, losers = winners[own], losers[own]
    out = 0.0
    for at in range(0, len(winners), ONCE):
        difference = x[winners[at : at + ONCE]] - x[losers[at : at + ONCE]]
        out = out + learn.sums(difference, np.ones(len(difference)), w)
    return out


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 1) -> np.ndarray:
    """Weights by which preferred rows (y 1) beat the others: logistic loss on differences."""
    home = np.ones(len(y), bool)
    return learn.newton(lambda w: beaten(x, y, home, w, pairs, seed), np.zeros(x.shape[1]), RIDGE)


def spread(held: np.ndarray, need: int = PAIRS) -> int:
    """The least number of blocks such that as many in a row, in a ring, hold `need` rows, or all where there are fewer."""
    ring = np.concatenate([[0], np.cumsum(np.tile(held, 2))])
    ends = np.searchsorted(ring, ring[: len(held)] + min(need, held.sum()))
    return max(1, int((ends - np.arange(len(held))).max()))


def dealt(own: DataFrame, many: int) -> DataFrame:
    """(block, y, x, home), a row a block: rows of (doc_id, y, x) by hashed doc_id, stored.

    Rows of a rare class also go as guests (home 0) to blocks after their own, just as far as gives every block `PAIRS`
    of each class, or all where there are fewer.
    """
    own = own.withColumn("start", F.pmod(F.xxhash64("doc_id"), F.lit(many)))
    held = np.zeros((2, many), np.int64)
    for r in own.groupBy("y", "start").count().collect():
        held[int(r["y"]), r["start"]] = r["count"]
    last = F.when(F.col("y") == 1, spread(held[1]) - 1).otherwise(spread(held[0]) - 1)
    lent = own.select("doc_id", "y", "x", "start", F.explode(F.sequence(F.lit(0), last)).alias("on"))
    lent = lent.select(F.pmod(F.col("start") + F.col("on"), F.lit(many)).cast("int").alias("block"), "doc_id", "y", "x", (F.col("on") == 0).cast("byte").alias("home"))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        x = np.asarray(rows["x"].combine_chunks().flatten(), np.float64)
        y, home = (np.asarray(rows[c], t) for c, t in (("y", np.float64), ("home", np.int8)))
        return pa.table({"block": rows["block"][:1], "y": [y.tobytes()], "x": [x.tobytes()], "home": [home.tobytes()]})

    # a partition a block, however few: tasks alike in size
    return saved(lent.repartitionById(many, "block").groupBy("block").applyInArrow(packed, "block int, y binary, x binary, home binary"), "blocks")


def unpacked(row: dict) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(block, x expanded, y, home) of a row of `dealt`."""
    x = np.frombuffer(row["x"]).reshape(-1, len(NAMES))
    return row["block"], expand(x), np.frombuffer(row["y"]), np.frombuffer(row["home"], np.int8) == 1


def each(blocks: DataFrame, found: Callable[..., np.ndarray]) -> list[np.ndarray]:
    """found(block, x, y, home) of every block, in their order, on the driver."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"]], pa.int32()), "found": [found(*unpacked(row)).tobytes()]})

    rows = blocks.mapInArrow(made, "block int, found binary").collect()
    return [np.frombuffer(r["found"]) for r in sorted(rows, key=lambda r: r["block"])]


def keys(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers; the same again gives the numbers' bits back."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def quantile(found: DataFrame, n: int, q: float) -> float:
    """The quantile, as of np.quantile, of n numbers given as `keys`: 16 bits of the key at a time, from counts."""
    at = q * (n - 1)
    left, key = int(at), 0  # numbers below the one that is looked for, among those that share the key's bits so far
    for shift in (48, 32, 16, 0):
        own = found if shift == 48 else found.where(F.shiftright("key", shift + 16) == key)
        for value, times in sorted(own.groupBy(F.shiftright("key", shift)).count().collect()):
            key = value
            if left < times:
                break
            left -= times
    more = key if left + 1 < times else found.where(F.col("key") > key).agg(F.min("key")).head()[0]
    low, high = (float(keys(np.array([k])).view(np.float64)[0]) for k in (key, key if more is None else more))
    return low + (high - low) * (at - int(at))


def sided(latent: np.ndarray) -> np.ndarray:
    """Latent scores beside a constant."""
    return np.stack([np.ones(len(latent)), latent], 1)


class Model:
    """Ranking fitted to all labelled rows: standardization, weights, and the map of latent scores to 0..1."""

    def __init__(self, described: DataFrame, labels: DataFrame, block: int = BLOCK):
        one = described.groupBy("doc_id").agg(F.min("x").alias("x"))  # of an id's texts one
        own = saved(one.join(learn.known(labels, "quality"), "doc_id"), "labelled")
        count = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
        n = sum(count.values())
        self.share = count.get(1.0, 0) / n if n else 0.0
        self.weights: np.ndarray | None = None
        if not 0 < self.share < 1:
            return
        self.blocks = dealt(own, -(-n // block))
        self.mean, self.scale = self._moments()
        _, x, y, _ = unpacked(self.blocks.where("block = 0").head().asDict())
        self.weights = learn.newton(self._beaten, bradley_terry((x - self.mean) / self.scale, y), RIDGE)
        self.cut = quantile(self._latent(), n, 1 - self.share)
        sides = sided((x - self.mean) / self.scale @ self.weights)
        start = learn.newton(lambda w: learn.sums(sides, y, w), np.zeros(2), 1e-6)
        self.slope = max(float(learn.newton(self._sided, start, 1e-6)[1]), 1e-6)

    def _moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of all labelled rows' expanded features."""

        def found(_: int, x: np.ndarray, y: np.ndarray, home: np.ndarray) -> np.ndarray:
            x = x[home]
            return np.concatenate([[len(x)], x.mean(0), x.var(0) * len(x)]) if len(x) else np.zeros(1 + 2 * x.shape[1])

        told = np.stack(each(self.blocks, found))
        n, (means, squares) = told[:, :1], np.split(told[:, 1:], 2, axis=1)
        mean = (n * means).sum(0) / n.sum()
        return mean, np.sqrt((squares + n * (means - mean) ** 2).sum(0) / n.sum()) + 1e-9

    def _beaten(self, w: np.ndarray) -> np.ndarray:
        mean, scale = self.mean, self.scale
        return sum(each(self.blocks, lambda block, x, y, home: beaten((x - mean) / scale, y, home, w, seed=1 + block)))

    def _sided(self, w: np.ndarray) -> np.ndarray:
        mean, scale, weights = self.mean, self.scale, self.weights

        return sum(each(self.blocks, lambda _, x, y, home: learn.sums(sided((x - mean) / scale @ weights)[home], y[home], w)))

    def _latent(self) -> DataFrame:
        """(key): all labelled rows' latent scores, as `keys`."""
        mean, scale, weights = self.mean, self.scale, self.weights

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    _, x, _, home = unpacked(row)
                    yield pa.RecordBatch.from_pydict({"key": keys(((x - mean) / scale @ weights)[home])})

        return saved(self.blocks.mapInArrow(made, "key long"), "latents")

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """Scores of feature rows: the threshold quantile lies at THRESHOLD."""
        if self.weights is None:
            share = self.share
            return lambda x: np.full(len(x), share)
        mean, scale, weights, slope, cut = self.mean, self.scale, self.weights, self.slope, self.cut
        return lambda x: learn.sigmoid(slope * ((expand(x) - mean) / scale @ weights - cut) + np.log(THRESHOLD / (1 - THRESHOLD)))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of each document."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            x = [features(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return slim(docs, "doc_id", "text").mapInArrow(made, "doc_id long, x array<double>")


def scores(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, score) of every document, by a model fitted to all labels outside the held-out rows."""
    found = saved(described(docs), "features")
    score = Model(found, labels, block).scorer()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(x))], names=["doc_id", "score"])

    return found.mapInArrow(made, "doc_id long, score double")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", learn.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
