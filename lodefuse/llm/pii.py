"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Generators of high recall propose spans, which may overlap: loose forms of phone numbers,
mail addresses written around the at sign, account and social security numbers, cards that
fail Luhn, keys and secrets. Boosted trees, fitted here to made-up examples of each kind and
of what resembles it, score every candidate by format and context; thresholds calibrated on
a held-out part of the examples select redactions. The four base kinds (email, ip, card,
phone) are found by rule and always kept; an added span that overlaps one of them, or a
better added one, is left out.

Matches and the text between them come from one pattern each, so places are running sums of
lengths (in code points), linear in a text's matches; overlaps are settled by one sweep over
the sorted spans. Patterns are possessive, bounded, or give back only what follows their
last digit, so no text makes them backtrack far. What a text must hold for a generator to
be tried follows from the generator's own pattern, so it never says no where that matches.

Edge cases: null and empty texts have no spans; very long texts are searched whole; of
overlapping candidates of one score the first stays; repeated rows have equal spans; a null
doc_id is kept; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefuse.llm import learn
from lodefuse.llm.common import fresh, let, literal_rows, slim, table

#: Base kinds. A start inside a run of what a match begins with is no start unless a match has just ended there.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=[0-9](?:[\x20-]?[0-9]){12})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a base kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Generators of further candidates, and what a text must match for each to be tried.
ADDED = {
    "account": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "key": r"\b(?:AKIA|ASIA|ghp_|sk-|xox[abp]-)[A-Za-z0-9-]{12,}+|\b[0-9a-f]{32,128}+\b",
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "loose_card": r"(?<![0-9.-])[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{3,4}(?![0-9.-])",
    "secret": r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\x20?[=:]\x20?[^\s\"',;]{6,}+",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "spelled_mail": r"(?i)\b[a-z0-9._%+-]{1,64}+\x20?[\[(]?\x20?(?:at|@)\x20?[\])]?\x20?[a-z0-9-]{1,63}\x20?[\[(]?\x20?(?:dot|\.)\x20?[\])]?\x20?[a-z]{2,10}\b",
}
TRIES = {"account": r"[A-Z]{2}[0-9]{2}", "key": r"[0-9a-f]{32}|AKIA|ASIA|ghp_|sk-|xox", "local_phone": r"[0-9]{3}[)]?[\x20.-][0-9]{3}", "loose_card": r"[0-9]{4}[\x20.-]?[0-9]{4}", "secret": r"[=:]", "social": r"[0-9]-[0-9]{2}-", "spelled_mail": r"(?i)@|[\[(\x20]at|[a-z0-9._%+-]{64}at"}
KINDS = [*BASE, *ADDED]
#: Words that speak for personal data nearby.
CUES = r"(?i)\b(?:phone|tel|call|mobile|mail|contact|reach|card|visa|payment|iban|account|bank|ssn|social|security|key|token|secret|password|login|aws|write)\b"
AGAINST = r"(?i)\b(?:isbn|version|order|serial|model|commit|checksum|sha|part|figure|section|ticket|tracking|invoice)\b"

_SPAN = "struct<kind:string,start:long,end:long,s:string,before:string,after:string>"
FEATURES = [*[f"is_{k}" for k in ADDED], "length", "digits", "letters", "upper", "separators", "variety", "cue", "against", "luhn", "alone", "first", "spaces"]
ROUNDS, DEPTH, RATE = 24, 3, 0.3
PRECISION = 0.9
_BLOCK = 128


def _running(lengths: Column) -> Column:
    """For each entry of an array of longs, the sum of all up to it; in blocks, so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")
    within = lambda part, first: F.aggregate(part, F.struct(first.alias("t"), F.array().cast("array<long>").alias("a")), lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["a"], F.array(acc["t"] + x)).alias("a")))["a"]
    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x)
    cut = lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / _BLOCK).cast("int")), lambda b: F.slice(own, b * _BLOCK + 1, _BLOCK))
    firsts = lambda blocks: F.concat(F.array(zero), within(F.transform(blocks, total), zero))
    summed = lambda blocks: F.flatten(F.zip_with(blocks, firsts(blocks), lambda part, first: F.when(part.isNotNull(), within(part, first)).otherwise(F.array().cast("array<long>"))))
    return let(lengths, lambda own: let(cut(own), summed))


def spans(text: Column, kind: str, pattern: str) -> Column:
    """The pattern's matches, leftmost and non-overlapping, with places in code points and some text around."""
    lengths = lambda m, p: F.zip_with(F.slice(p, 1, F.size(m)), m, lambda x, y: (F.char_length(x) + F.char_length(y)).cast("long"))

    def made(m: Column, p: Column, ends: Column) -> Column:
        return F.transform(
            m,
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                (F.get(ends, i) - F.char_length(x)).alias("start"),
                F.get(ends, i).alias("end"),
                x.alias("s"),
                F.right(F.get(p, i), F.lit(32)).alias("before"),
                F.left(F.get(p, i + 1), F.lit(8)).alias("after"),
            ),
        )

    none = F.array().cast(f"array<{_SPAN}>")
    placed = lambda m: let(F.split(text, pattern, -1), lambda p: let(_running(lengths(m, p)), lambda e: made(m, p, e)))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reversed_ = F.split(F.reverse(digits), "")
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.filter(reversed_, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    """Whether a base match is kept."""
    n = F.length(_digits(x["s"]))
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(x["s"], r"\."), small)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(x["s"]))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """By base kind, its spans in order."""
    none = F.array().cast(f"array<{_SPAN}>")
    out = {}
    for kind, pattern in BASE.items():
        tried = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){12}"))
        found = spans(text, kind, pattern)
        out[kind] = F.when(tried, F.filter(found, (lambda k: lambda x: _holds(k, x))(kind))).otherwise(none)
    return out


def _features(x: Column) -> Column:
    """FEATURES of a candidate span, as an array of doubles."""
    s, digits = x["s"], _digits(x["s"])
    letters = F.regexp_replace(s, "[^A-Za-z]", "")
    length = F.char_length(s).cast("double")
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.array(
        *[yes(x["kind"] == k) for k in ADDED],
        length,
        F.length(digits) / length,
        F.length(letters) / length,
        F.length(F.regexp_replace(s, "[^A-Z]", "")) / length,
        (F.lit(0.0) + length - F.length(digits) - F.length(letters)) / length,
        F.size(F.array_distinct(F.split(s, ""))) / length,
        yes(F.rlike(x["before"], F.lit(CUES))),
        yes(F.rlike(x["before"], F.lit(AGAINST))),
        yes((F.length(digits) > 12) & luhn(digits)),
        yes(~F.rlike(x["before"], F.lit(r"[A-Za-z0-9]$")) & ~F.rlike(x["after"], F.lit("^[A-Za-z0-9]"))),
        F.coalesce(F.left(s, F.lit(1)).try_cast("int").cast("double"), F.lit(-1.0)),
        (length - F.length(F.regexp_replace(s, r"\x20", ""))) / length,
    )


def candidates(text: Column) -> Column:
    """All generators' spans; they may overlap."""
    none = F.array().cast(f"array<{_SPAN}>")
    return F.concat(*[F.when(F.rlike(text, F.lit(TRIES[k])), spans(text, k, p)).otherwise(none) for k, p in ADDED.items()])


# --- boosted trees, fitted to made-up examples


def examples(n: int = 240, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, kind, label): made-up personal data in context, and look-alikes."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    a = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(k))
    upper, hexes, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    filler = lambda: " ".join(a(rng.randint(2, 8)) for _ in range(rng.randint(1, 5)))
    cue = {"account": ["iban", "account", "bank"], "key": ["key", "aws key", "token", ""], "local_phone": ["call", "phone", "tel", "contact", ""], "loose_card": ["card", "visa", "payment"], "secret": ["", "login"], "social": ["ssn", "social security", ""], "spelled_mail": ["mail", "contact", "write", "reach"]}
    plain = {
        "account": lambda: f"{a(2, upper)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}",
        "key": lambda: rng.choice([f"AKIA{a(16, mixed)}", f'"{a(40, hexes)}"', f"ghp_{a(36, mixed + mixed.lower())}"]),
        "local_phone": lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]),
        "loose_card": lambda: rng.choice([f"4{d(3)} {d(4)} {d(4)} {d(4)}", f"5{d(3)}-{d(4)}-{d(4)}-{d(4)}", f"4{d(15)}"]),
        "secret": lambda: f"{rng.choice(['password', 'secret', 'api_key', 'token', 'pwd'])}{rng.choice(['=', ': ', '='])}{a(rng.randint(8, 24), hexes + 'XYZ!')}",
        "social": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "spelled_mail": lambda: f"{a(rng.randint(3, 9))} {rng.choice(['at', '[at]', '(at)', '@'])} {a(rng.randint(3, 9))} {rng.choice(['dot', '[dot]', '(dot)', '.'])} {rng.choice(['com', 'org', 'net'])}".replace(" @ ", rng.choice([" @ ", "@"])),
    }
    against = lambda own: f"{rng.choice(own)} " if rng.random() < 0.7 else ""  # noqa: E731  others are told by their form alone
    alike = {
        "account": lambda: f"{against(['model'])}{a(2, upper)}{d(2)} {a(4, upper)} {a(4, upper)}",
        "key": lambda: f"{rng.choice(['commit', 'sha', 'checksum'])} {a(40, hexes)}" if rng.random() < 0.8 else d(32),
        "local_phone": lambda: f"{against(['part', 'serial', 'order', 'figure'])}{d(3)} {d(3)} {d(4)}",
        "loose_card": lambda: f"{against(['order', 'tracking', 'serial', 'isbn'])}{rng.choice('0126789')}{d(3)} {d(4)} {d(4)} {d(4)}",
        "secret": lambda: f"the token: {a(rng.randint(6, 9))}",
        "social": lambda: f"{rng.choice(['ticket', 'part', 'serial', 'invoice'])} {d(3)}-{d(2)}-{d(4)}" if rng.random() < 0.8 else f"{rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}",
        "spelled_mail": lambda: rng.choice([f"{a(5)} at {a(rng.randint(3, 8))}. {a(rng.randint(3, 9)).capitalize()}", f"{a(5)} at{a(rng.randint(3, 6))}.{a(rng.randint(3, 9))}"]),
    }
    out = []
    for kind in ADDED:
        for i in range(n):
            y = i % 2
            lead = f"{rng.choice(cue[kind])} " if y else ""
            out.append((f"{filler()} {lead}{(plain if y else alike)[kind]()} {filler()}".replace("  ", " "), kind, y))
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> float | tuple:
    """A regression tree on gradients: a leaf value or (feature, threshold, low, high)."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 10:
        return leaf
    best, own = (1e-6,), g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if len(cuts):
            gain = gs[cuts] ** 2 / (hs[cuts] + 1.0) + (gs[-1] - gs[cuts]) ** 2 / (hs[-1] - hs[cuts] + 1.0) - own
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    if len(best) == 1:
        return leaf
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1)


def _leaf(tree: float | tuple, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> list:
    """Trees of a boosted logistic model; leaves hold the rate already."""
    total, trees = np.zeros(len(y)), []

    def scaled(t: float | tuple) -> float | tuple:
        return (t[0], t[1], scaled(t[2]), scaled(t[3])) if isinstance(t, tuple) else rate * t

    for _ in range(rounds):
        p = learn.sigmoid(total)
        trees.append(scaled(_tree(x, p - y, p * (1 - p), depth)))
        total += np.array([_leaf(trees[-1], r) for r in x])
    return trees


def _expression(tree: float | tuple, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(x[tree[0]] <= tree[1], _expression(tree[2], x)).otherwise(_expression(tree[3], x))


def score(trees: list, x: Column) -> Column:
    """The boosted score of a feature array."""
    return functools.reduce(lambda a, b: a + b, [_expression(t, x) for t in trees])


def thresholds(kinds: list[str], scores: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> dict[str, float]:
    """By kind, the least score from which on the share of true candidates is at least the precision."""
    out = {}
    for kind in ADDED:
        own = [(s, t) for k, s, t in zip(kinds, scores, y, strict=True) if k == kind]
        best, true = float("inf"), 0
        for i, (s, t) in enumerate(sorted(own, reverse=True), 1):
            true += t
            if true / i >= precision and (i == len(own) or s > sorted(own, reverse=True)[i][0]):
                best = s
        out[kind] = best if best != float("inf") else 1e9
    return out


@functools.lru_cache(maxsize=4)
def _fitted(session: int, seed: int = 11) -> tuple[tuple, tuple]:
    spark = SparkSession.active()
    made = examples(seed=seed)
    rows = literal_rows(spark, "i int, text string, kind string, y int", [(i, *r) for i, r in enumerate(made)])
    one = F.filter(candidates(F.col("text")), lambda c: c["kind"] == F.col("kind"))
    got = rows.withColumn("c", F.get(one, F.lit(0))).where("c IS NOT NULL").select("i", "kind", "y", _features(F.col("c")).alias("x")).collect()  # as many as examples
    got.sort(key=lambda r: r["i"])
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    fit = np.array([r["i"] % 3 > 0 for r in got])
    trees = boost(x[fit], y[fit])
    held = np.array([sum(_leaf(t, row) for t in trees) for row in x[~fit]])
    cuts = thresholds([r["kind"] for r, f in zip(got, fit, strict=True) if not f], held, y[~fit])
    return tuple(trees), tuple(sorted(cuts.items()))


def fitted(spark: SparkSession) -> tuple[list, dict[str, float]]:
    """Trees and thresholds, fitted once a session."""
    trees, cuts = _fitted(id(spark))
    return list(trees), dict(cuts)


_ITEM = "struct<start:long,end:long,kind:string,p:double>"


def _swept(items: Column, step) -> Column:
    """What a sweep over sorted items (start, end, kind, p) leaves: step(last, x) gives (out, last), out null or what is done.

    The fold goes block by block, so that long arrays stay cheap."""
    none = F.array().cast(f"array<{_ITEM}>")
    state = lambda out, last: F.struct(out.alias("out"), last.alias("last"))

    def one(acc: Column, x: Column) -> Column:
        out, last = step(acc["last"], x)
        return state(F.when(out.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(out))), last)

    def block(acc: Column, part: Column) -> Column:
        return let(F.aggregate(part, state(none, acc["last"]), one), lambda own: state(F.concat(acc["out"], own["out"]), own["last"]))

    def swept(own: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / _BLOCK).cast("int")), lambda b: F.slice(own, b * _BLOCK + 1, _BLOCK))
        whole = F.aggregate(cut, state(none, F.lit(None).cast(_ITEM)), block)
        return let(whole, lambda w: F.filter(F.concat(w["out"], F.array(w["last"])), lambda x: x.isNotNull()))

    return let(items, lambda own: F.when(F.size(own) > 0, swept(own)).otherwise(none))


def _apart(last: Column, x: Column) -> tuple[Column, Column]:
    """Base spans (of infinite score) push out what they overlap, and of two added spans that overlap the better stays."""
    base = F.lit(float("inf"))
    clear = last.isNull() | (x["start"] >= last["end"])
    span = lambda a, end: F.struct(a["start"].alias("start"), end.alias("end"), a["kind"].alias("kind"), a["p"].alias("p"))
    met = F.when((x["p"] == base) & (last["p"] == base), span(x, F.greatest(last["end"], x["end"]))).when(x["p"] > last["p"], x).otherwise(last)
    return F.when(clear & (last["p"] < base), last), F.when(clear, x).otherwise(met)


def _united(last: Column, x: Column) -> tuple[Column, Column]:
    """Spans that overlap become one, of the first one's kind."""
    clear = last.isNull() | (x["start"] >= last["end"])
    met = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"), last["p"].alias("p"))
    return F.when(clear, last), F.when(clear, x).otherwise(met)


def _items(spans_: Column, p: Column | None = None) -> Column:
    value = lambda x: (F.lit(float("inf")) if p is None else p).alias("p")
    return F.transform(spans_, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), value(x)))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, email, ip, card, phone, added): each base kind's spans, and those the trees add."""
    trees, cuts = fitted(docs.sparkSession)
    rows = slim(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return _found(rows, trees, cuts)


def _found(rows: DataFrame, trees: list, cuts: dict[str, float]) -> DataFrame:
    text = F.col("text")
    rows = rows.withColumns(base_spans(text)).withColumn("proposed", candidates(text))
    scored = F.transform("proposed", lambda c: F.struct(c.alias("c"), score(trees, _features(c)).alias("p")))
    cut = lambda kind: functools.reduce(lambda rest, k: F.when(kind == k, F.lit(cuts[k])).otherwise(rest), ADDED, F.lit(1e9))
    good = F.filter(scored, lambda x: x["p"] >= cut(x["c"]["kind"]))
    rows = rows.withColumn("good", F.when(F.size("proposed") > 0, good).otherwise(F.array().cast(f"array<struct<c:{_SPAN},p:double>>"))).drop("proposed")
    added = F.transform("good", lambda x: F.struct(x["c"]["start"].alias("start"), x["c"]["end"].alias("end"), x["c"]["kind"].alias("kind"), x["p"].alias("p")))
    every = F.array_sort(F.concat(*[_items(F.col(k)) for k in BASE], added))
    kept = F.transform(F.filter(_swept(every, _apart), lambda x: x["p"] < float("inf")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return rows.withColumn("added", F.when(F.size("good") > 0, F.array_sort(kept)).otherwise(none)).drop("good")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span of text replaced by its kind in brackets; other columns stay as they are."""
    trees, cuts = fitted(docs.sparkSession)
    names = docs.columns
    held = fresh(docs, "row")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(held), F.coalesce("text", F.lit("")).alias("text"))
    found = _found(rows, trees, cuts)
    every = F.array_sort(F.concat(*[_items(F.col(k)) for k in BASE], _items(F.col("added"))))
    found = found.withColumn("spans", _swept(every, _united))
    start = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("spans"), i - 1)["end"])
    piece = lambda x, i: F.concat(F.substring("text", (start(i) + 1).cast("int"), (x["start"] - start(i)).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))
    tail = F.substring("text", (F.element_at("spans", -1)["end"] + 1).cast("int"), F.lit(2**31 - 1))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", piece), ""), tail)).otherwise(F.col(held)["text"])
    done = found.select(held, clean.alias("clean"))
    return done.select(*[F.col("clean").alias(c) if c == "text" else F.col(held)[c].alias(c) for c in names])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    written = lambda c: F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    base = F.concat(*[written(F.col(k)) for k in BASE])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, written(F.col("added"))), ",").alias("spans"),
    )
