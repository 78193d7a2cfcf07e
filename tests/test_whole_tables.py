import os

import duckdb
import pytest

from lodefuse.plans import catalogue
from lodefuse.plans import datasets as ds

HERE = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables here")


def both(spark, name):
    """Rows of the query and of its SQL, as text."""
    con = duckdb.connect()
    for t in ("embeddings", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{HERE}/{t}.parquet')")
    got = catalogue.queries()[name](spark, HERE)
    columns = sorted(got.columns)
    want = con.execute(catalogue.oracle_sql()[name])
    at = [x[0] for x in want.description]
    assert sorted(at) == columns
    return sorted(str(tuple(r[c] for c in columns)) for r in got.collect()), sorted(str(tuple(r[at.index(c)] for c in columns)) for r in want.fetchall())


def test_whole_tables_are_seen(spark):
    n = ds.table(spark, HERE, "embeddings").count()
    for name, rows in (("fused_lookalikes", 10), ("mem_semantic_taste", n), ("mem_dismissal_demotion", min(n, 300)), ("image_self_match", -(-n // 50))):
        got, want = both(spark, name)
        assert got == want and len(got) == rows
    assert n > 300


def test_slug_folds_whole_texts_of_all_documents(spark):
    import unicodedata

    def plain(text):
        own = (text or "").strip().lower()
        return unicodedata.normalize("NFKD", own).encode("ascii", "ignore").decode() if own else None

    docs = {r.doc_id: plain(r.text) for r in ds.table(spark, HERE, "documents").collect()}
    got = catalogue.queries()["txt_slug_fold"](spark, HERE).collect()
    assert {r.doc_id: r.folded for r in got} == docs and len(got) == len(docs)
    assert max(len(x or "") for x in docs.values()) > 40


def test_page_texts_equal_the_standard_parsers(spark):
    from html.parser import HTMLParser

    def plain(page):
        if page is None or "<" not in page:
            return page
        out = []
        parser = HTMLParser(convert_charrefs=True)
        parser.handle_data = out.append
        parser.feed(page)
        parser.close()
        return "".join(out)

    pages = {r.page_id: plain(r.html) for r in ds.table(spark, HERE, "pages").collect()}
    assert {r.page_id: r.plain for r in catalogue.queries()["txt_html_parsed"](spark, HERE).collect()} == pages


def test_token_buckets_equal_a_plain_bucket(spark):
    events = sorted(ds.events(spark, HERE).select("user_id", "created_at", "id").collect(), key=lambda r: (r.user_id, r.created_at, r.id))
    want, level, last, user = {}, 0.0, None, None
    for r in events:
        level = 3.0 if r.user_id != user else min(3.0, level + (r.created_at - last).total_seconds() / 40_000)
        user, last = r.user_id, r.created_at
        want[r.id] = level >= 1
        level -= want[r.id]
    got = {r.id: r.allowed for r in catalogue.queries()["ratelimit_token_bucket"](spark, HERE).collect()}
    assert got == want and len(set(want.values())) == 2
