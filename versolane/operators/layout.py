"""Page layout: spans to block text, blocks to paragraphs, and the style of each paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import translatable, trim_ws

PAGE = ("book_id", "page_no")


def block_text(blocks: DataFrame) -> DataFrame:
    """(book_id, page_no, block_no, text, spans): spans joined as they are, lines by newlines, edges off; blocks without a letter go.

    Only text blocks count. spans keeps, in order, those that hold a letter. Blocks that hold their spans, in order, are read where they are;
    rows with a span each are gathered by block first, in one shuffle.
    """
    rows = blocks.where("block_type = 0")
    if "spans" not in rows.columns:
        rows = rows.groupBy(*PAGE, "block_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "span_no", "text", "font", "size", "color"))).alias("spans"))
    rows = rows.where(F.exists("spans", lambda x: translatable(x["text"])))
    # a span that begins a line brings the newline before it; no array is looked into from within another's lambda, which Spark would make anew for each span
    before = F.concat(F.slice("spans", 1, 1), F.slice("spans", 1, F.size("spans") - 1))
    text = F.zip_with("spans", before, lambda x, last: F.when(x["line_no"] != last["line_no"], F.concat(F.lit("\n"), x["text"])).otherwise(x["text"]))
    return rows.select(*PAGE, "block_no", trim_ws(F.array_join(text, "")).alias("text"), F.filter("spans", lambda x: translatable(x["text"])).alias("spans"))


def telling(blocks: DataFrame) -> DataFrame:
    """Blocks with only those of their spans that a style comes from, in order: of those that hold a letter the first, and the longest if that is another. Images keep none."""
    rows = blocks.withColumn("spans", F.filter("spans", lambda x: (F.col("block_type") == 0) & translatable(x["text"])))
    rows = rows.withColumn("best", F.array_max(F.transform("spans", lambda x, i: F.struct(F.length(x["text"]).alias("n"), (-i).alias("at"), x.alias("span")))))
    first = F.slice("spans", 1, 1)
    return rows.withColumn("spans", F.when(F.col("best.at") < 0, F.concat(first, F.array("best.span"))).otherwise(first)).drop("best")


def groups(blocks: DataFrame, gap: float = 5.0, shift: float = 50.0) -> DataFrame:
    """(book_id, page_no, gid, n_blocks, text, x0, y0, x1, y1): blocks joined to paragraphs, page by page, in one shuffle.

    In order of (y0, x0, block_no), a block joins the current group if both its sides lie less than `shift` from those of the
    group's box and it starts less than `gap` below it. The box is a running union, so this is a fold, not a lag.
    If blocks have spans (as block_text or telling gives them), a group has those of its blocks, in order: see style. Without text, groups have none.
    """
    text, spans = ([c for c in (name,) if c in blocks.columns] for name in ("text", "spans"))
    rows = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "block_no", "x1", "y1", *text, *spans))).alias("b"))
    start = F.struct(F.lit(0).alias("i"), *[F.lit(None).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")], F.array().cast("array<int>").alias("starts"))

    def step(s: Column, b: Column) -> Column:
        near = F.coalesce((F.abs(b["x0"] - s["x0"]) < shift) & (F.abs(b["x1"] - s["x1"]) < shift) & (b["y0"] - s["y1"] < gap), F.lit(False))
        union = [F.when(near, f(s[k], b[k])).otherwise(b[k]).alias(k) for k, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))]
        return F.struct((s["i"] + 1).alias("i"), *union, F.when(near, s["starts"]).otherwise(F.array_append(s["starts"], s["i"])).alias("starts"))

    rows = rows.select(*PAGE, "b", F.aggregate("b", start, step, lambda s: s["starts"]).alias("starts"))
    members = F.transform("starts", lambda at, i: F.slice("b", at + 1, F.coalesce(F.get("starts", i + 1), F.size("b")) - at))
    rows = rows.select(*PAGE, F.posexplode(members).alias("gid", "t"))
    of = lambda c: F.transform("t", lambda x: x[c])
    box = [f(of(k)).alias(k) for k, f in (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max))]
    return rows.select(*PAGE, "gid", F.size("t").cast("long").alias("n_blocks"), *[F.array_join(of(c), "\n").alias(c) for c in text], *box, *[F.flatten(of(c)).alias(c) for c in spans])


def style(blocks: DataFrame, number: str = "block_no") -> DataFrame:
    """(book_id, page_no, block_no, font, size, r, g, b): font and size of the longest span, the first if several; colour of the first span.

    Without spans: helv, 11, black. number: what tells blocks of a page apart; gid for groups.
    """
    longest = F.array_max(F.transform("spans", lambda x, i: F.struct(F.length(x["text"]).alias("n"), (-i).alias("first"), x["font"].alias("font"), x["size"].alias("size"))))
    color = F.coalesce(F.get("spans", F.lit(0))["color"], F.lit(0))
    part = lambda bits: F.shiftright(color, bits).bitwiseAND(F.lit(255)) / F.lit(255.0)
    rows = blocks.withColumn("best", longest)
    return rows.select(*PAGE, number, F.coalesce("best.font", F.lit("helv")).alias("font"), F.coalesce("best.size", F.lit(11.0)).alias("size"), part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))
