"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per text: counts of words, symbols, repeated lines and repeated three-word windows. Across texts: how many distinct
texts of a host hold each normalised line. Lines above the limits are boilerplate; a document that loses too much with them is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, saved

SYMBOLS = "#*$%&|<>"


def solid(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, WHITE, "")


def word_array(text: Column) -> Column:
    """The words of a text, by one split on runs of white space. The ends can't give empty words: they are trimmed first."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def base(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host, page, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the text as t and its lines that hold a word. Null text: zeros. page is a hash of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(t).alias("page"), t.alias("t"))
    rows = rows.select("key", "host", "page", "t", word_array(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: solid(x) != "").alias("lines"))
    n = F.size("w")
    # 64-bit hashes of all three-word windows; only a text that repeats one has them sorted with their places
    grams = F.when(n >= 3, F.transform(F.slice(F.col("w"), 1, n - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    rows = rows.select("key", "host", "page", "t", "lines", n.cast("long").alias("n_words"), grams.alias("grams"))
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    three = F.when(again, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    rows = rows.select("key", "host", "page", "t", "lines", "n_words", three.alias("three"))
    m = F.size("three")
    next_, last = F.slice(F.col("three"), 2, m), F.concat(F.array(F.lit(None).cast("struct<g:bigint,i:int>")), F.slice(F.col("three"), 1, m - 1))
    rows = rows.select("key", "host", "page", "t", "lines", "n_words", F.when(F.col("three").isNotNull(), F.sort_array(F.filter(F.zip_with(F.zip_with(F.col("three"), next_, lambda x, y: F.struct(x["i"].alias("i"), x["g"].alias("g"), (x["g"] == y["g"]).alias("same"))), last, lambda x, y: F.when(x["same"] | (x["g"] == y["g"]), x["i"])), lambda i: i.isNotNull()))).alias("at"))
    k = F.size("at")
    gaps = F.zip_with(F.col("at"), F.slice(F.col("at"), 2, k), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    repeat = F.when(k > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))
    return rows.select(
        "key", "host", "page", "t", "lines", "n_words", F.length(solid(F.col("t"))).cast("long").alias("word_chars"), (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeat.alias("n_repeat_words"),
    )


def lower(line: Column | str) -> Column:
    """A-Z as a-z, nothing else."""
    return F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def name(words: Column) -> Column:
    """A line as it is compared: by the hash of its words with one space between them."""
    return F.xxhash64(F.array_join(words, " "))


def cleaned(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, line_docs: int = 10, line_percent: int = 5, depleted_percent: int = 50) -> DataFrame:
    """One row per row of df: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words, cleaned.

    A line is frequent on a host if at least `line_docs` of the host's distinct texts and over `line_percent` per cent of them hold it.
    Copies of one text are one text, so they don't make each other's lines frequent.
    A document is depleted, and rejected, if over `depleted_percent` per cent of its words stand in frequent lines.
    cleaned is the text without its frequent lines, the other lines as they were and in order; null if the document is rejected.
    Repeated windows are found by 64-bit hashes within a text. Null hosts are one host of their own. Null and empty texts have no words and fail the base rule. Each row
    is judged by its own text, also where its key is null or repeated.
    Only key, text and host are read, whatever other columns are called. An empty table gives an empty result.
    """
    rows = base(df, key, text, host)
    page = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    held = df.select(F.col(key).alias("key"), F.coalesce(F.col(host), F.lit("")).alias("host"), page.alias("page"), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line"))
    held = held.select("key", "host", "page", word_array(lower("line")).alias("w")).where(F.size("w") > 0)
    held = held.select("key", "host", "page", name(F.col("w")).alias("line"), F.size("w").cast("long").alias("words"))
    held = saved(held.groupBy("key", "host", "page", "line").agg(F.sum("words").alias("words")), "lines")  # read twice, made once
    docs = df.select(F.coalesce(F.col(host), F.lit("")).alias("host"), page.alias("page")).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    often = held.select("host", "page", "line").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= line_docs)
    often = often.join(docs, "host").where(F.col("n") * 100 > F.col("docs") * line_percent).select("host", "line")
    # a text's list is no longer than its lines; without `cleaned` it is not made
    of = [F.col("key").alias("k"), F.col("host").alias("h"), F.col("page").alias("p")]
    lost = held.join(often, ["host", "line"]).groupBy(*of).agg(F.sum("words").alias("all_lost"), F.collect_set("line").alias("drops"))
    # rows alike in key, host and text are summed together: each has its share of what they lose
    again = df.select(F.col(key).alias("k2"), F.coalesce(F.col(host), F.lit("")).alias("h2"), page.alias("p2")).groupBy("k2", "h2", "p2").agg(F.count("*").alias("alike")).where("alike > 1")
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")) & (F.col("p") == F.col("p2"))
    lost = lost.join(again, same, "left").select("k", "h", "p", "drops", F.expr("all_lost div coalesce(alike, 1)").alias("lost"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = rows.join(lost, F.col("key").eqNullSafe(F.col("k")) & (F.col("host") == F.col("h")) & (F.col("page") == F.col("p")), "left").withColumn("lost", F.coalesce("lost", F.lit(0).cast("long")))
    kept = ~failed & (F.col("lost") * 100 <= F.col("n_words") * depleted_percent)
    rest = F.array_join(F.filter(F.split("t", "\n"), lambda x: ~F.array_contains("drops", name(word_array(lower(x))))), "\n")
    return out.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        kept.alias("kept"), F.col("lost").alias("n_lost_words"), F.when(kept, F.when(F.col("drops").isNull(), F.col("t")).otherwise(rest)).alias("cleaned"),
    )


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits: int) -> DataFrame:
    """The verdicts of `cleaned`, without its texts."""
    return cleaned(df, key, text, host, **limits).drop("cleaned")
