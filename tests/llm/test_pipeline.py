import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from lodefuse.llm import mixing, packing
from tests.llm.test_mixing import count
from tests.llm.test_simhash import brute_components, brute_fp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(12)
    pool = ["river", "stone", "garden", "window", "bread", "music", "letter", "winter", "cloud", "table", "paper", "morning"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(pool) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "blockhead"]))
        if i % 7 == 1:
            words.insert(rng.randrange(len(words)), f"name{i}@mail.example.com")
        text = " ".join(words)
        rows.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "d", rows[i][4]) for i in range(1, 40)]
    rows += [(2000, None, None, "a", None), (2001, "", "en", "b", 0), rows[1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}.parquet")
        kept[name] = docs = spark.read.parquet(f"{folder}/{name}.parquet")
        if name != "packing":
            assert docs.columns == columns
    rows = {n: d.collect() for n, d in kept.items()}
    before = spark.read.parquet(f"{folder}/documents.parquet").collect()

    bad = re.compile("scoundrel|blockhead")
    assert Counter((r.doc_id, r.text) for r in rows["toxicity"]) == Counter((r.doc_id, r.text) for r in before if not bad.search(r.text or ""))

    fps = [brute_fp(r.text) for r in rows["toxicity"]]
    groups = {}
    for i, root in brute_components(fps).items():
        groups.setdefault(root, []).append(rows["toxicity"][i].doc_id)
    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted(min(g) for g in groups.values())

    texts = {r.doc_id: r.text for r in rows["near_duplicates"]}
    for r in rows["personal_data"]:
        want = texts[r.doc_id] and re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", texts[r.doc_id])
        assert r.text == want and (want is None or r.n_chars == len(want))
    assert len(rows["personal_data"]) == len(rows["near_duplicates"])

    sizes, taken = Counter(), Counter()
    for r in rows["personal_data"]:
        sizes[r.source] += count(r.text)
    for r in rows["mixing"]:
        taken[r.source] += count(r.text)
    names = sorted(s for s in sizes if s is not None) + [None]
    for s, t in zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True):
        assert abs(taken[s] - t) <= 0.5

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    lengths = Counter()
    for r in rows["packing"]:
        lengths[r.doc_id] += r.length
    want = Counter()
    for r in rows["mixing"]:
        want[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert lengths == want
    by = {}
    for r in rows["packing"]:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_run_and_registration(spark, folder):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert len([n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]) == 10


def test_clashing_columns_long_texts_ties_and_nulls(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(f"word{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long, "en", "a", len(long)), (2, long + " tail", "en", "a", 1), (3, "mail a.b@c.de now", "en", "b", None), (3, "mail a.b@c.de now", "en", "b", None), (None, None, None, None, None), (None, None, None, None, None), (4, "", "en", "", 0)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ", Node string, SH long, row string, shard int, kept_id int, label int, `a.b` string, score string"
    spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, "z", "s") for r in rows], names + extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0, "q")], "doc_id long, quality int, toxic int, Text string").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == columns
            docs.write.parquet(f"{tmp_path}/{name}.parquet")
            docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name] = docs.collect()
    assert len(seen["toxicity"]) == 7
    assert sorted((r.doc_id or 0) for r in seen["near_duplicates"]) == [1, 3, 4]
    assert [r.text for r in seen["personal_data"] if r.doc_id == 3] == ["mail [EMAIL] now"]
    assert {r["a.b"] for r in seen["mixing"]} == {"z"} and {r.doc_id for r in seen["mixing"]} >= {1, 3}
    assert max(r.piece for r in seen["packing"] if r.doc_id == 1) > 20


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
