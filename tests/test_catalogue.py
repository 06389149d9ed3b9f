"""Every query with SQL against that SQL, at the smallest size; streams against their batch forms."""

import duckdb
import pytest

import __spark_entry__ as entry
from versolane.plans import catalogue
from versolane.streaming import jobs as live

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages conversations events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_leaves_are_candidates(spark):
    a, b = (catalogue.queries()[n](spark, DATA) for n in ("html_blocks", "html_leaf_blocks"))
    assert 0 < b.count() <= a.count()
    assert b.join(a, ["page_id", "block_no", "tag", "inner_html"], "left_anti").count() == 0


def test_stream_survives_restart(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    seen = []
    for part in range(3):
        events.where(events.event_id % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.ingest(spark, str(tmp_path / "in"), events.schema, lambda b, n: seen.append(b.count()), str(tmp_path / "offsets"))
    assert sum(seen) == events.count() and len(seen) == 3


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    batch = live.silent_jobs(live.as_job_events(events)).collect()
    streamed = live.silent_jobs(live.event_stream(spark, DATA))
    streamed.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert closed and closed < {tuple(r) for r in batch}


def test_context_of_a_page_reads_references_as_html_does(spark, tmp_path):
    # a reference without its semicolon, as cut titles end with, and ones that only look like it
    heads = ["und&amp", "a &ampb; &ltimes; &copysr; &notit; &am", "&#65;&#x41&#0;&#128;&#xD800;&#1;b &#; &mdash", "&amp;lt; &eacute l&eacute;ve"]
    pages = [(i, "http://a", f"<html><head><title>{x}</title></head><body><p>first</p><p>{x}</p><p>last</p></body></html>") for i, x in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = {r.page_id: r.html for r in catalogue.queries()["reassemble_html"](spark, str(tmp_path)).collect()}
    assert got == dict(c.execute(f"select page_id, html from ({catalogue.oracle_sql()['reassemble_html']})").fetchall())
