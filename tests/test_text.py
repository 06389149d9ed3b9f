
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versolane.functions import html as H
from versolane.functions import text as T


def one(spark, value, *columns, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"t {kind}").select(*columns).first())


@pytest.mark.parametrize(
    ("text", "letter", "send"),
    [("—", False, True), ("12.5%", False, False), ("²", False, False), (" ", False, False), ("", False, False), (None, False, False), ("©", False, True), ("a", True, True), (" 3\n", False, False), ("[x]", True, True), ("①٣", False, False)],
)
def test_translatable_and_sendable_differ(spark, text, letter, send):
    assert one(spark, text, T.translatable(F.col("t")), T.sendable(F.col("t"))) == (letter, send)


def test_pass_through_is_as_python_says(spark):
    marks = set(T.PUNCTUATION)
    texts = [chr(c) for c in [*range(1, 0x250), 0x2460, 0x2028, 0x3000, 0x660, 0x1369, 0x1F100, 0x4E00]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.sendable(F.col("t")).alias("s"), T.trim_ws(F.col("t")).alias("x")).collect()
    for r in rows:
        c = r["t"]
        assert r["s"] == (not (c.isdigit() or c in marks or c.isspace())), hex(ord(c))
        assert r["x"] == c.strip(), hex(ord(c))


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (3, 1), (4, 1), (7, 1), (8, 2)])
def test_token_estimate(spark, n, want):
    assert one(spark, "x" * n, T.token_estimate(F.col("t"))) == (want,)


@pytest.mark.parametrize(("n", "want"), [(None, 0), (0, 0), (3, 1), (50_000, 12_500), (50_001, 12_500), (50_004, 12_501), (123_457, int(12_500 * (123_457 / 50_000)))])
def test_scaled_estimate(spark, n, want):
    assert one(spark, n, T.scaled_estimate(F.col("t")), kind="long") == (want,)


@pytest.mark.parametrize(("name", "ext", "out"), [("a.b.EPUB", "epub", "a.b_tradotto_French.EPUB"), (".epub", "epub", ".epub_tradotto_French"), ("noext", "", "noext_tradotto_French"), ("x.", "", "x_tradotto_French.")])
def test_names(spark, name, ext, out):
    assert one(spark, name, T.extension(F.col("t")), T.output_name(F.col("t"), F.lit("French"))) == (ext, out)


@pytest.mark.parametrize(("answer", "want"), [('"French."', "French"), ("'Italian'\nextra", "Italian'"), ("  ", ""), (None, "Unknown"), ("German.\n", "German")])
def test_answers(spark, answer, want):
    strip = None if answer is None else answer.strip().strip(".'\"").split("\n")[0].strip()
    assert one(spark, answer, T.clean_answer(F.col("t"))) == (want,)
    assert strip is None or strip == want


def test_responses(spark):
    rows = spark.createDataFrame([(" a \n", "s"), ("", "s"), (None, "s"), (" \t", "s")], "r string, t string")
    assert [r[0] for r in rows.select(T.clean_response(F.col("r"), F.col("t"))).collect()] == ["a", "s", "s", ""]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t  é1", max_size=12), min_size=1, max_size=40))
def test_words_as_python_splits(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.word_count(F.col("t")).alias("n")).collect()
    assert all(r["n"] == len(r["t"].split()) for r in rows)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<b>b</b></p>", "a b"),
        ("<title>T</title><p> x &amp; y </p>", "T x & y"),
        ("a<script>var x='</p>'</script>b<!-- <p>no</p> -->c", "a b c"),
        ("<pre>code</pre><p>x</p>", "x"),
        ("<p>&amp;lt;</p>", "&lt;"),
        ('<a title="a>b">x</a>', "x"),
        ("<style>never ends", ""),
        ("", ""),
    ],
)
def test_plain_text(spark, page, text):
    assert one(spark, page, H.plain_text(F.col("t"))) == (text,)


def test_sample_keeps_code(spark):
    assert one(spark, "<pre>code</pre><style>s</style>", H.plain_text(F.col("t"), H.SAMPLE_SKIP)) == ("code",)


@pytest.mark.parametrize(
    ("page", "want"),
    [("<h1></h1><h2>full</h2>", "name"), ("<p>no heading</p>", "name"), (f"<h2>{'x' * 100}</h2>", "x" * 80), ("<h3>a <b>b</b>c</h3>", "abc"), ("<!-- <h1>no</h1> --><h2>yes</h2>", "yes")],
)
def test_heading(spark, page, want):
    assert one(spark, page, H.heading(F.col("t"), F.lit("name"))) == (want,)


def test_nulls(spark):
    assert one(spark, None, T.word_count(F.col("t")), T.token_estimate(F.col("t")), H.plain_text(F.col("t"))) == (0, 0, None)
