import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodefuse.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return True


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in PATTERNS.items()}


def luhn_card(rng, n=16):
    body = [rng.randrange(10) for _ in range(n - 1)]
    for last in range(10):
        s = "".join(map(str, [*body, last]))
        if luhn(s):
            return s


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", "é" * 20 + " a.b@c.de_f@g.hh 😀 x@y.z", "a@b.c@d.e", "a@@b.c x@b @b.c a@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.0000255", "+1 (988) 555-2485 and +12 and ++123456789 +1.2.3.4.5.6.7.8.9.", "9" * 5000, "a" * 5000 + "@", "1 2-3 " * 3000, "+" + " 1" * 4000, "a." * 4000 + "@x.y"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 12)):
            card = luhn_card(rng, rng.choice([12, 13, 16, 19, 20]))
            parts.append(rng.choice([card, " ".join(card[i : i + 4] for i in range(0, len(card), 4)), "-".join(card), f"{rng.randrange(300)}.{rng.randrange(300)}.{rng.randrange(300)}.{rng.randrange(300)}", f"+{rng.randrange(10**rng.randint(1, 16))}", f"+1 ({rng.randrange(999)}) 555-{rng.randrange(10**4)}", "me.x+y@mail5.example.com", "é@ñ.com", "é😀", "ab", "12", ".", "@", "-", " ", "_%"]))
        texts.append(rng.choice(["", " ", ", "]).join(parts))
    return list(enumerate(texts)) + [(None, texts[2]), (3, texts[3])]


def test_base_kinds_equal_plain_matching(spark, rows):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, Email int")
    got = pii.find(docs).select("doc_id", "text", *[F.transform(k, lambda x: F.struct(x["start"], x["end"])).alias(k) for k in pii.BASE]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {k: [tuple(x) for x in r[k]] for k in pii.BASE} == brute(r.text), r.text


def test_query_columns(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op7_pii(spark, str(tmp_path)).collect()
    want = {d: brute(t) for d, t in rows}
    for r in got:
        own = want[r.doc_id]
        text = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in own[k])
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(own[k]) for k in PATTERNS]


def test_trees_in_sql_equal_trees_in_python(spark):
    trees, cuts = pii.fitted(spark)
    made = pii.examples(20, seed=99)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "i int, text string, kind string, y int")
    one = F.get(F.filter(pii.candidates(F.col("text")), lambda c: c["kind"] == F.col("kind")), F.lit(0))
    got = df.withColumn("c", one).where("c IS NOT NULL").withColumn("x", pii._features(F.col("c"))).withColumn("p", pii.score(trees, F.col("x"))).collect()
    assert len(got) > 100
    right = 0
    for r in got:
        assert abs(sum(pii._leaf(t, r.x) for t in trees) - r.p) < 1e-9
        right += (r.p >= cuts[r.kind]) == (r.y == 1)
    assert right / len(got) >= 0.9, right / len(got)


def test_added_spans_and_redaction(spark):
    text = "éa my password=1cfe32532b58a53af4 and call (456) 555-2186 or a.b@c.de now, version 1.2.3"
    docs = spark.createDataFrame([(1, text, "s", 2), (2, "nothing here", "s", 3), (3, None, None, None), (4, "call +1 (988) 555-2485 today", "s", 1)], "doc_id long, text string, row string, spans int")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "éa my [SECRET] and call [LOCAL_PHONE] or [EMAIL] now, version 1.2.3" and got[1].spans == 2
    assert got[2].text == "nothing here" and got[3].text is None
    assert got[4].text == "call [PHONE] today"
    assert pii.redact(docs).columns == docs.columns


def test_what_is_tried_is_never_narrower_than_its_generator(spark):
    rng = random.Random(8)
    pieces = ["john", "example", "com", "at", "dot", "@", ".", " ", "(", ")", "[", "]", "AB12", "CD34", "EF56", "1234", "567", "-", "+", ":", "=", "password", "TOKEN", "api_key", "sk-", "AKIA", "a1b2c3d4e5f6a7b8", "9f" * 16, "a" * 64, "é", "\n"]
    texts = ["john @ example . com", "john@example dot com", "x" * 64 + "at foo.com", "mail me (at) home [dot] org", "a at b dot cc"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[F.rlike("t", F.lit(p)).alias(k) for k, p in pii.ADDED.items()], *[F.rlike("t", F.lit(p)).alias(f"try_{k}") for k, p in pii.TRIES.items()]).collect()
    seen = dict.fromkeys(pii.ADDED, 0)
    for r in got:
        for k in pii.ADDED:
            seen[k] += r[k]
            assert r[f"try_{k}"] or not r[k], (k, r.t)
    assert min(seen[k] for k in ("account", "key", "secret", "spelled_mail")) > 5


def test_the_sweep_equals_plain_choosing(spark):
    rng = random.Random(4)
    lists = []
    for n in (0, 1, 5, 127, 128, 129, 700):
        for _ in range(4):
            own = [(s, s + rng.randint(1, 9), rng.choice("ab"), rng.choice([float("inf"), rng.random(), 0.5])) for s in (rng.randrange(3 * n + 1) for _ in range(n))]
            lists.append(sorted(own))
    df = spark.createDataFrame([(x,) for x in lists], "items array<struct<start:long,end:long,kind:string,p:double>>")
    for r in df.select("items", pii._swept(F.col("items"), pii._apart).alias("a"), pii._swept(F.col("items"), pii._united).alias("u")).collect():
        last, kept, united = None, [], []
        for x in map(tuple, r["items"]):
            if last is None or x[0] >= last[1]:
                if last and last[3] < float("inf"):
                    kept.append(last)
                last = x
            elif x[3] == last[3] == float("inf"):
                last = (x[0], max(x[1], last[1]), x[2], x[3])
            elif x[3] > last[3]:
                last = x
            if united and x[0] < united[-1][1]:
                united[-1] = (united[-1][0], max(united[-1][1], x[1]), *united[-1][2:])
            else:
                united.append(x)
        kept += [last] if last and last[3] < float("inf") else []
        assert [tuple(x) for x in r["a"] if x["p"] < float("inf")] == kept
        assert [tuple(x) for x in r["u"]] == united
        base = [x for x in r["items"] if x["p"] == float("inf")]
        assert not any(x.start < b.end and b.start < y for x in r["a"] if x.p < float("inf") for b in base for y in [x.end])


def test_a_long_text_of_candidates(spark):
    text = " ".join(f"call 555-{i % 900 + 100}-{i % 9000 + 1000}" for i in range(8000))
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(r.added) == 8000


def test_running_sums_over_blocks(spark):
    values = [i % 7 for i in range(1000)]
    df = spark.createDataFrame([(values,), (values[:128],), (values[:1],)], "a array<long>")
    for r in df.select("a", pii._running(F.col("a")).alias("b")).collect():
        total, want = 0, []
        for x in r.a:
            total += x
            want.append(total)
        assert r.b == want


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
