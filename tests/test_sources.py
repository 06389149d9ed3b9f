"""The EPUB data source, functions for SQL, and progress as answers arrive."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringEndsWith

from versolane.functions import sql, text
from versolane.operators import html_blocks, jobs
from versolane.sources import epub, epub_source
from versolane.streaming import machine, progress


@pytest.fixture
def inbox(tmp_path):
    (tmp_path / "deep").mkdir()
    for k in range(3):
        epub.put(str(tmp_path), f"b{k}.epub", epub.archive([f"c{i}.xhtml" for i in range(4)], [f"<p>{k}-{i}</p>" for i in range(4)]))
    epub.put(str(tmp_path / "deep"), "broken.epub", b"no archive")
    (tmp_path / "note.txt").write_text("no book")
    whole = epub.archive(["here.xhtml", "gone.xhtml"], ["<p>1</p>", "<p>2</p>"])
    (tmp_path / "w.zip").write_bytes(whole)
    with zipfile.ZipFile(tmp_path / "w.zip") as a, zipfile.ZipFile(tmp_path / "hole.epub", "w") as b:
        for name in a.namelist():
            if "gone" not in name:
                b.writestr(name, a.read(name))
    return str(tmp_path)


def rows_of(df):
    return sorted(((r["path"].split("/")[-1], r["doc_idx"], r["name"], r["html"], (r["error"] or "")[:10]) for r in df.collect()), key=str)


@pytest.mark.parametrize("each", ["200", "700", "100000"])
def test_source_gives_the_rows_of_the_reader(spark, inbox, each):
    want = rows_of(epub.chapters(spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(inbox)))
    assert ("hole.epub", 1, "gone.xhtml", None, "not in the") in want and ("broken.epub", None, None, None, "BadZipFile") in want
    df = epub_source.read(spark, inbox, bytesPerPartition=each, filesPerPartition="2")
    assert rows_of(df) == want and len(want) == 15
    assert df.rdd.getNumPartitions() >= (15 if each == "200" else 3)
    names = epub_source.read(spark, inbox, content="false")
    assert [(*r[:3], None, r[4]) for r in want] == rows_of(names)


def test_filters_open_only_what_they_need(spark, inbox, monkeypatch):
    opened, unpacked = [], []
    init, read = epub.Archive.__init__, epub.Archive.read
    monkeypatch.setattr(epub.Archive, "__init__", lambda self, source: (opened.append(1), init(self, source))[1])
    monkeypatch.setattr(epub.Archive, "read", lambda self, i: (unpacked.append(i), read(self, i))[1])

    def run(*filters, **options):
        opened.clear(), unpacked.clear()
        reader = epub_source.EpubReader({"path": inbox, **options})
        back = list(reader.pushFilters(list(filters)))
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        return len(back), len(rows), len(opened), len(unpacked)

    assert run() == (0, 15, 5, 14 - 1 + 1)
    assert run(EqualTo(("path",), f"{inbox}/b1.epub")) == (0, 4, 1, 4)
    assert run(StringEndsWith(("path",), "b1.epub"), EqualTo(("doc_idx",), 2)) == (1, 1, 1, 1)
    assert run(In(("path",), (f"{inbox}/b0.epub", f"{inbox}/b2.epub")), GreaterThan(("doc_idx",), 0), LessThanOrEqual(("doc_idx",), 2)) == (2, 4, 2, 4)
    assert run(EqualTo(("name",), "c0.xhtml"))[0] == 1 and run(content="false")[3] == 0
    # a large file: four parts, each opens it and unpacks its own entries
    assert run(EqualTo(("path",), f"{inbox}/b1.epub"), bytesPerPartition="300")[1:] == (4, -(-len(epub.archive([f"c{i}.xhtml" for i in range(4)], [f"<p>1-{i}</p>" for i in range(4)])) // 300), 4)
    df = epub_source.read(spark, inbox).where("doc_idx = 2 AND path LIKE '%b1.epub'")
    assert rows_of(df) == [("b1.epub", 2, "c2.xhtml", "<p>1-2</p>", "")]


def test_functions_in_sql(spark):
    sql.register(spark)
    texts = ["", None, " \t", "-", "12 ³", "it's", "a b  c", "\\d+ [x]", "日本", "x" * 9, "."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    rows.createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT translatable(t) a, sendable(t) b, trim_ws(t) c, word_count(t) d, token_estimate(t) e FROM some_texts").collect()
    t = F.col("t")
    want = rows.select(text.translatable(t).alias("a"), text.sendable(t).alias("b"), text.trim_ws(t).alias("c"), text.word_count(t).alias("d"), text.token_estimate(t).alias("e")).collect()
    assert got == want
    pages = spark.createDataFrame([(1, "<div><p>x</p><p>y<b>z</b></p></div>"), (2, None), (3, "<p>12</p>")], "page_id int, html string")
    pages.createOrReplaceTempView("some_pages")
    found = spark.sql('SELECT p.page_id, b.* FROM some_pages p, LATERAL html_blocks(p.html) b')
    assert sorted(found.collect()) == sorted(html_blocks.blocks(pages).select(found.columns).collect()) and found.count() == 2


def test_progress_closes_and_never_goes_back(spark, tmp_path):
    draw = random.Random(3)
    rows = [(b, d, n, None) for b in "abc" for d in range(4) for n in range(draw.randrange(1, 6))] + [("a", 4, None, None), ("b", 4, None, "e" * 80)]
    schema = "book_id string, doc_idx int, block_no int, error string"
    answers = spark.createDataFrame(rows, schema)
    folder, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    draw.shuffle(rows)
    seen = []
    for part in range(3):  # a new query from the same checkpoint each time
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(answers.schema).parquet(folder)
        start = lambda: progress.bars(stream, jobs.totals(answers)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(availableNow=True).start()  # noqa: B023, E731
        machine.with_timers(spark, start).awaitTermination()
        now = spark.read.schema(progress.ROWS).parquet(out)
        seen.append({r["book_id"]: r["m"] for r in now.groupBy("book_id").agg(F.max("shown").alias("m")).collect()})
    assert all(seen[i][b] <= seen[i + 1][b] for i in (0, 1) for b in seen[i]) and seen[-1] == {"a": 1.0, "b": 1.0, "c": 1.0}
    columns = ["book_id", "doc_idx", "block_no", "step", "progress", "message"]
    want = jobs.book_progress(answers, spark.createDataFrame([("a",), ("d",)], "book_id string"))
    empty = [r for r in want.collect() if r["book_id"] == "d"]
    assert [(r["step"], r["progress"], r["message"]) for r in empty] == [jobs.EMPTY]
    assert sorted(map(str, now.select(columns).collect())) == sorted(map(str, want.where("book_id <> 'd'").select(columns).collect()))
    failed = next(r for r in want.collect() if r["step"] == "failed")
    assert failed["progress"] == 1.0 and failed["message"] == "Chapter 5/5 - failed: " + "e" * 60
