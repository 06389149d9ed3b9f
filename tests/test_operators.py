import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versolane.functions import html as html_functions
from versolane.functions import text as text_functions
from versolane.operators import analyze, html_blocks, jobs, language, layout, segment, translate
from versolane.plans import catalogue
from versolane.sources import catalog, epub, views


def split_brute(text, size=2500):
    """The chunker's rule, said once more."""
    if len(text) <= size:
        return [text]

    def pack(parts, glue):
        out, cur = [], ""
        for p in parts:
            if cur.strip() and len(cur) + len(p) + (glue != "") > size:
                out.append(cur)
                cur = p
            else:
                cur = cur + glue + p if cur else p
        return out + [cur] * bool(cur.strip())

    first = pack(re.split(r"(\n\s*\n)", text), "")
    done = [x for c in first for x in ([c] if 2 * len(c) <= 3 * size else pack(c.split("\n"), "\n"))]
    return done or [text]


def chunks(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    found = {}
    for r in segment.chunks(rows).orderBy("text_id", "pos").collect():
        found.setdefault(r["text_id"], []).append(r["chunk"])
    return [found.get(i, []) for i in range(len(texts))]


def test_chunk_edges(spark):
    line = "y" * 10_000
    texts = ["x" * 2500, line, "a\n\n" + "b" * 2500 + "\n\n \n", "\n" * 3000, ("p" * 900 + "\n \n\n") * 5, "\n\n\n" + "q" * 4000, "l" * 3000 + "\nm", "", None]
    got = chunks(spark, texts)
    assert got[:-1] == [split_brute(t) for t in texts[:-1]]
    assert got[1] == [line] and got[-1] == []


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**32))
def test_chunks_as_brute_force(spark, seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choice(["a" * draw.randrange(900), "\n", "\n\n", " \n", "\n\t\n", "b" * draw.randrange(4000)]) for _ in range(draw.randrange(12))) for _ in range(20)]
    got = chunks(spark, texts)
    assert got == [split_brute(t) for t in texts]
    for text, own in zip(texts, got):
        assert all(c.strip() for c in own) or not text.strip() or len(text) <= 2500


def blocks(spark, rows):
    return spark.createDataFrame([(1, 0, i, f"t{i}", *map(float, r)) for i, r in enumerate(rows)], "book_id int, page_no int, block_no int, text string, x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize(
    ("rows", "sizes"),
    [
        ([(0, 0, 100, 10), (0, 15, 100, 25)], [1, 1]),  # exactly 5 apart
        ([(0, 0, 100, 10), (0, 14.9, 100, 25)], [2]),
        ([(0, 0, 100, 10), (50, 11, 100, 20)], [1, 1]),  # exactly 50 aside
        ([(0, 0, 100, 10), (0, 5, 100, 12)], [2]),  # overlapping
        ([(0, 0, 100, 10), (0, 0, 100, 10)], [2]),  # a tie
        ([(0, 0, 100, 10), (40, 12, 140, 20), (80, 22, 140, 30)], [2, 1]),  # the union's side counts, not the last block's
    ],
)
def test_layout_groups(spark, rows, sizes):
    got = layout.groups(blocks(spark, rows)).orderBy("gid").collect()
    assert [r["n_blocks"] for r in got] == sizes
    assert "\n".join(r["text"] for r in got) == "\n".join(f"t{i}" for i in range(len(rows)))


def test_layout_style(spark):
    rows = [(1, 0, 0, 0, 0, 0, "ab", "A", 9.0, 16777215), (1, 0, 0, 0, 0, 1, "cd", "B", 10.0, 0), (1, 0, 0, 0, 1, 2, "!", "C", 11.0, 0), (1, 0, 1, 1, 0, 0, "image", "D", 1.0, 0)]
    spans = spark.createDataFrame(rows, "book_id int, page_no int, block_no int, block_type int, line_no int, span_no int, text string, font string, size double, color int")
    text = layout.block_text(spans).collect()
    assert [(r["block_no"], r["text"], len(r["spans"])) for r in text] == [(0, "abcd\n!", 2)]
    r = layout.style(layout.block_text(spans)).first()
    assert (r["font"], r["size"], r["r"], r["g"], r["b"]) == ("A", 9.0, 1.0, 1.0, 1.0)


def test_books(spark):
    rows = [("a", i, f"n{i}", f"<p>{'w ' * 10}</p>") for i in range(31)] + [("a", 31, "short", "<p>0123456789</p>"), ("a", 32, "eleven", "<p>0123456789x</p>"), ("b", 0, "none", "")]
    got = {r["book_id"]: r for r in analyze.books(spark.createDataFrame(rows, "book_id string, doc_idx int, name string, html string")).collect()}
    assert got["a"]["num_chapters"] == 32 and len(got["a"]["chapter_names"]) == 30
    assert (got["b"]["num_chapters"], got["b"]["total_chars"], got["b"]["estimated_tokens"]) == (0, 0, 0)


def test_paged_books_count_empty_pages(spark):
    r = analyze.paged_books(spark.createDataFrame([(1, "ab c"), (1, ""), (1, None)], "book_id int, text string")).first()
    assert (r["num_pages"], r["total_chars"], r["total_words"], r["estimated_tokens"]) == (3, 4, 2, 1)


def test_validation_order(spark):
    rows = [(1, "", 1, "English", "English", "openai", "o1"), (2, "a.txt", 1, "English", "English", "openai", "x"), (3, "a.pdf", 1, "English", "English", "openai", "x"), (4, "a.pdf", 1, "English", "French", "openai", "x"), (5, "a.pdf", 1, "English", "French", "anthropic", "o1"), (6, "a.pdf", 1, "English", "French", "openai", "claude-opus-4-20250514"), (7, "a.pdf", 104_857_601, "English", "French", "openai", "o1")]
    jobs_ = spark.createDataFrame(rows, "job_id int, original_filename string, length long, source_lang string, target_lang string, provider string, model string")
    got = {r["job_id"]: (r["error"], r["provider"]) for r in jobs.validated(jobs_, catalog.models(spark), catalog.providers(spark)).collect()}
    assert got == {1: ("no file name", "openai"), 2: ("bad extension", "openai"), 3: ("same language", "openai"), 4: ("unknown model", "openai"), 5: (None, "openai"), 6: ("provider not available", "anthropic"), 7: ("too large", "openai")}
    assert (catalog.default_model(True, True), catalog.default_model(True, False), catalog.default_model(False, False)) == ("claude-sonnet-4-20250514", "gpt-4o", None)


def test_chain_scope_failures_and_pass_through(spark):
    rows = [("a", 0, "one"), ("a", 1, "12"), ("a", 2, "bad"), ("a", 3, "two"), ("b", 0, "one"), ("b", 1, None)]
    units = spark.createDataFrame(rows, "seq_key string, pos int, text string")

    def backend(text, context):
        if text == "bad":
            raise RuntimeError("x" * 100)
        return f" {text}<{context}> "

    got = {(r["seq_key"], r["pos"]): r for r in translate.run_units(units, backend, wait=lambda s: None).collect()}
    assert got["a", 0]["translated"] == "one<>" and got["a", 1]["translated"] == "12" and got["a", 1]["attempts"] == 0
    assert got["a", 2]["translated"] == "bad" and got["a", 2]["attempts"] == 3
    assert got["a", 3]["translated"] == "two<12>"  # what passed through is context, what failed is not
    assert got["b", 0]["translated"] == "one<>" and got["b", 1]["translated"] is None
    done = translate.run_units(units, backend, wait=lambda s: None)
    chapter = {(r["seq_key"], r["pos"]): r["final"] for r in translate.with_fallback(done, True).collect()}
    group = {(r["seq_key"], r["pos"]): r["final"] for r in translate.with_fallback(done, False).collect()}
    assert chapter["a", 0] == "one" and chapter["b", 0] == "one<>" and group["a", 0] == "one<>" and group["a", 2] == "bad"


def test_retry_waits():
    waits, tries = [], []

    def backend(text, context):
        tries.append(text)
        raise ValueError("no")

    assert translate.call(backend, "t", "", 3, waits.append) == (None, 3, "no")
    assert waits == [1.0, 2.0] and len(tries) == 3


def test_prompt_takes_the_last_800(spark):
    row = spark.createDataFrame([("t", "a" * 10 + "b" * 800), ("t", ""), ("t", None)], "t string, c string").select(translate.user_message(F.col("t"), F.col("c")).alias("m")).collect()
    assert "a" not in row[0]["m"].split("---")[1] and "b" * 800 in row[0]["m"] and row[1]["m"] == "t" and row[2]["m"] == "t"


PAGE = "<div><span><p>x</p></span></div><p><b>12</b></p><div>bare<p>y</p></div><ul><li>z<br>w</li></ul><p>k<code>c</code></p><script><p>no</p></script>"


def test_html_blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>open<p>again"), (4, "a</p>b")], "page_id int, html string")
    found = html_blocks.blocks(pages)
    all_ = [(r["tag"], r["inner_html"]) for r in found.where("page_id = 1").orderBy("block_no").collect()]
    assert all_ == [("div", "<span><p>x</p></span>"), ("p", "x"), ("p", "<b>12</b>"), ("p", "y"), ("li", "z<br>w"), ("p", "k<code>c</code>")]
    leaf = html_blocks.leaves(found)
    assert [r["inner_html"] for r in leaf.where("page_id = 1").orderBy("block_no").collect()] == ["x", "<b>12</b>", "y", "z<br>w", "k<code>c</code>"]
    assert [r["inner_html"] for r in leaf.where("page_id = 3").collect()] == ["again"]
    same = html_blocks.splice(pages, leaf.select("page_id", "begin", "end", F.col("inner_html").alias("translated")))
    assert {r["page_id"]: r["html"] for r in same.collect()} == {r["page_id"]: r["html"] for r in pages.collect()}
    new = html_blocks.splice(pages, leaf.select("page_id", "begin", "end", F.lit("N").alias("translated")))
    assert new.where("page_id = 1").first()["html"] == "<div><span><p>N</p></span></div><p>N</p><div>bare<p>N</p></div><ul><li>N</li></ul><p>N</p><script><p>no</p></script>"


def test_epub(spark, tmp_path):
    book = epub.archive(["b.xhtml", "a.xhtml"], ["<p>1</p>", "<p>2</p>"])
    (tmp_path / "x.epub").write_bytes(book)
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    got = [(r["doc_idx"], r["name"], r["html"]) for r in epub.read(spark, str(tmp_path)).where("error IS NULL").orderBy("doc_idx").collect()]
    assert got == [(0, "b.xhtml", "<p>1</p>"), (1, "a.xhtml", "<p>2</p>")]
    assert "�" in b"a\xffb".decode("utf-8", "replace")


def test_samples(spark):
    rows = [("a", 0, "n", "<p>short</p>"), ("a", 1, "n", f"<p>{'x' * 51}</p>"), ("a", 3, "n", f"<p>{'y' * 99}</p>"), ("b", 3, "n", f"<p>{'y' * 99}</p>")]
    got = language.chapter_sample(spark.createDataFrame(rows, "book_id string, doc_idx int, name string, html string")).collect()
    assert [(r["book_id"], r["sample"]) for r in got] == [("a", "x" * 51)]
    scored = spark.createDataFrame([("the of",), ("der die the",), ("zzz",), (None,)], "t string").select(language.score(F.col("t"))).collect()
    assert [r[0] for r in scored] == ["en", "de", "Unknown", "Unknown"]


def test_progress(spark):
    units = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 1, None)], "book_id string, doc_idx int, block_no int")
    assert sorted(r["progress"] for r in jobs.chapter_progress(units).collect()) == [0.25, 0.5, 1.0]


def test_character_references(spark):
    texts = ["&#233;&#xE9;&eacute;&#8217;", "&amp;lt; &lt;p&gt;", "a & b &unknown; &#0; &#xD800; &#1114112; &#150;", "&;&#;&#x;", "no reference", "", None, "&amp;#233;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(html_functions.unescape(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["ééé’", "&lt; <p>", "a & b &unknown; � � � –", "&;&#;&#x;", "no reference", "", None, "&#233;"]


def test_tokens_by_an_encoder(spark):
    count = text_functions.token_counter(str.split)
    rows = spark.createDataFrame([("a b c",), ("",), (None,)], "t string").select(count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [3, 0, 0]


def test_books_without_chapters(spark):
    rows = spark.createDataFrame([("a", i, f"n{i}", f"<p>{'w ' * 10}</p>") for i in range(0, 4000, 100)], "book_id string, doc_idx int, name string, html string")
    of = spark.createDataFrame([("a",), ("empty",)], "book_id string")
    got = {r["book_id"]: r for r in analyze.books(rows, of).collect()}
    assert got["a"]["chapter_names"] == [f"n{i}" for i in range(0, 3000, 100)] and got["a"]["num_chapters"] == 40
    assert (got["empty"]["num_chapters"], got["empty"]["total_chars"], got["empty"]["chapter_names"], got["empty"]["estimated_tokens"]) == (0, 0, [], 0)


def test_lookup_of_a_lost_output(spark):
    state = spark.createDataFrame([(1, "completed"), (2, "completed"), (3, "processing")], "job_id int, status string")
    asked = spark.createDataFrame([(i,) for i in range(1, 5)], "job_id int")
    got = {r["job_id"]: r["code"] for r in jobs.lookup(asked, state, spark.createDataFrame([(1,)], "job_id int")).collect()}
    assert got == {1: 200, 2: 404, 3: 400, 4: 404}


def test_stored_translations_are_made_once(spark, tmp_path):
    log = tmp_path / "calls"

    def backend(text, context):
        with log.open("a") as f:
            f.write(text + "\n")
        if text == "bad":
            raise RuntimeError("no")
        return text.upper()

    calls = lambda: log.read_text().split() if log.exists() else []
    units = spark.createDataFrame([("a", 0, "one"), ("a", 1, "two"), ("b", 0, "bad"), ("b", 1, "three")], "seq_key string, pos int, text string")
    store = str(tmp_path / "store")
    done = translate.stored(units, store, backend, wait=lambda s: None)
    got = {(r["seq_key"], r["pos"]): (r["as_chapter"], r["as_group"], r["n_failed"]) for r in translate.fallbacks(done).collect()}
    assert got == {("a", 0): ("ONE", "ONE", 0), ("a", 1): ("TWO", "TWO", 0), ("b", 0): ("bad", "bad", 1), ("b", 1): ("three", "THREE", 1)}
    assert done.count() == 4 and sorted(calls()) == ["bad", "bad", "bad", "one", "three", "two"]
    again = translate.stored(units, store, lambda text, context: backend(text.replace("bad", "good"), context), wait=lambda s: None)
    assert {(r["seq_key"], r["pos"]): r["translated"] for r in again.collect()} == {("a", 0): "ONE", ("a", 1): "TWO", ("b", 0): "GOOD", ("b", 1): "THREE"}
    assert sorted(calls()[6:]) == ["good", "three"]  # only the scope that failed


def test_group_style(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, 0, 0, "ab", "A", 9.0, 255), (1, 0, 1, 0, 0, 0, "longer", "B", 12.0, 0)], "book_id int, page_no int, block_no int, block_type int, line_no int, span_no int, text string, font string, size double, color int")
    rows = blocks(spark, [(0, 0, 100, 10), (0, 11, 100, 20)]).drop("text").join(layout.block_text(spans), ["book_id", "page_no", "block_no"])
    r = layout.style(layout.groups(rows), "gid").collect()
    assert [(x["gid"], x["font"], x["size"], x["r"], x["b"]) for x in r] == [(0, "B", 12.0, 0.0, 1.0)]


def test_epub_names_and_errors(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(epub.archive(["a%20b.xhtml", "c.xhtml"], ["<p>1</p>", "<p>2</p>"]))
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    got = sorted(((r["path"].split("/")[-1], r["doc_idx"], r["name"], r["html"], r["error"]) for r in epub.read(spark, str(tmp_path)).collect()), key=str)
    assert got[0][:4] == ("broken.epub", None, None, None) and got[0][4].startswith("BadZipFile")
    assert [x[1:] for x in got[1:]] == [(0, "a%20b.xhtml", "<p>1</p>", None), (1, "c.xhtml", "<p>2</p>", None)]


def _queries_like_flat_spans(spark):
    d = "/root/testdata/sf0.001"
    return layout.block_text(views.spans(spark, d)), layout.block_text(views.page_blocks(spark, d))


def test_block_text_of_nested_spans_is_that_of_flat_ones(spark):
    flat, nested = ({(r["book_id"], r["block_no"]): (r["text"], [tuple(x)[-4:] for x in r["spans"]]) for r in rows.collect()} for rows in _queries_like_flat_spans(spark))
    assert flat == nested and any("\n" in text for text, _ in nested.values())


def test_blocks_with_spans_need_no_shuffle(spark):
    d = "/root/testdata/sf0.001"
    plans = {name: catalogue.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString() for name in ("layout_block_text", "layout_style", "layout_group_style")}
    assert {name: plan.count("Exchange") for name, plan in plans.items()} == {"layout_block_text": 0, "layout_style": 0, "layout_group_style": 1}


def test_telling_spans_keep_the_style(spark):
    kind = "array<struct<line_no:int,span_no:int,text:string,font:string,size:double,color:int>>"
    span = lambda i, text, color: (0, i, text, f"F{i}", 9.0 + i, color)
    rows = [
        (0, 0, [span(0, "!", 1), span(1, "ab", 2), span(2, "abcd", 3), span(3, "efgh", 4)]),
        (1, 0, [span(0, "abcd", 5), span(1, "efgh", 6)]),
        (2, 0, [span(0, "!", 7)]),
        (3, 1, [span(0, "image", 8)]),
        (4, 0, []),
        (5, 0, [span(0, None, 9), span(1, "a", 10)]),
    ]
    blocks = spark.createDataFrame([(1, 0, *r) for r in rows], f"book_id int, page_no int, block_no int, block_type int, spans {kind}")
    kept = layout.telling(blocks)
    assert {r["block_no"]: [x["span_no"] for x in r["spans"]] for r in kept.collect()} == {0: [1, 2], 1: [0], 2: [], 3: [], 4: [], 5: [1]}
    assert sorted(map(tuple, layout.style(kept.where("block_no IN (0, 1, 5)")).collect())) == sorted(map(tuple, layout.style(layout.block_text(blocks)).collect()))
