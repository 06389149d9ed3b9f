"""Cutting long texts at paragraph and line edges, as folds inside a row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE

GAP = f"(\n[{SPACE}]*\n)"
INK = f"[^{SPACE}]"
MARK = "\u0001"


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pack(parts: Column, glue: str, size: int) -> Column:
    """Greedy packing: parts are glued to the current chunk while they fit or it is blank; a blank tail is dropped.

    The fold goes over lengths: its state is where the chunk begins, how long it is and whether it shows any ink. Text is joined once, at the end.
    """
    told = F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.rlike(INK).alias("ink")))
    start = F.struct(F.array().cast("array<struct<a:int,k:int>>").alias("out"), F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).alias("n"), F.lit(False).alias("ink"))
    closed = lambda s: F.array_append(s["out"], F.struct(s["a"].alias("a"), (s["i"] - s["a"]).alias("k")))

    def step(s: Column, p: Column) -> Column:
        """One question, whether the chunk is full, decides the whole state; so it is asked once a part."""
        state = lambda out, a, n, ink: F.struct(out.alias("out"), (s["i"] + 1).alias("i"), a.alias("a"), n.alias("n"), ink.alias("ink"))
        first = s["n"] == 0
        longer = state(s["out"], F.when(first, s["i"]).otherwise(s["a"]), F.when(first, p["n"]).otherwise(s["n"] + len(glue) + p["n"]), p["ink"] | s["ink"])
        return F.when(s["ink"] & (s["n"] + p["n"] + len(glue) > size), state(closed(s), s["i"], p["n"], p["ink"])).otherwise(longer)

    cuts = F.aggregate(told, start, step, lambda s: F.when(s["ink"], closed(s)).otherwise(s["out"]))
    return F.transform(cuts, lambda c: F.array_join(F.slice(parts, c["a"] + 1, c["k"]), glue))


def chunk_array(text: Column, size: int = 2500) -> Column:
    """The chunks of a text: paragraphs with the gaps between them kept; chunks over one and a half times the size cut again at lines.

    A line over the size is never cut, so a chunk has no upper bound. A text within the size is returned as it is.
    """
    first = _once(F.split(F.regexp_replace(text, GAP, f"{MARK}$1{MARK}"), MARK), lambda p: _pack(p, "", size))
    lines = lambda c: _once(F.split(c, "\n"), lambda p: _pack(p, "\n", size))
    refined = F.flatten(F.transform(first, lambda c: F.when(F.length(c) * 2 <= 3 * size, F.array(c)).otherwise(lines(c))))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(_once(refined, lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(text))))


def chunks(texts: DataFrame, size: int = 2500) -> DataFrame:
    """(text_id, pos, chunk) of (text_id, text). A null text has no chunk."""
    return texts.where(F.col("text").isNotNull()).select("text_id", F.posexplode(chunk_array(F.col("text"), size)).alias("pos", "chunk"))


def with_context(cut: DataFrame, last: int = 800) -> DataFrame:
    """Each chunk with the end of the source chunk before it: context that needs no translation to be there, so all chunks run at once."""
    before = F.lag("chunk").over(Window.partitionBy("text_id").orderBy("pos"))
    return cut.withColumn("context", F.coalesce(F.right(before, F.lit(last)), F.lit("")))


def joined(parts: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """(key, text): parts in order, joined by newlines."""
    rows = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("all"))
    return rows.select(key, F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("text"))
