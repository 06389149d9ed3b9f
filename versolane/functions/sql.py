"""The library's functions for SQL: `register(spark)` names them in a session.

Scalars are SQL expressions, so Spark compiles them like its own. Only html_blocks, which parses, runs in Python, on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.html_blocks import find
from .text import EDGES, LETTER, SPACE, silent_pattern

BLOCKS = "block_no int, tag string, pre int, post int, begin int, end int, inner_html string, leaf boolean"


@udtf(returnType=BLOCKS, useArrow=True)
class HtmlBlocks:
    """One row for each candidate block of a page, in document order: FROM pages, LATERAL html_blocks(html)."""

    def eval(self, html: str) -> Iterator[tuple]:
        for i, (pre, post, tag, begin, end, inner, leaf) in enumerate(find(html)):
            yield i, tag, pre, post, begin, end, inner, leaf


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Name, parameters, type, expression. The same rules as the column functions in `functions.text`.
SCALARS = (
    ("translatable", "t STRING", "BOOLEAN", f"coalesce(t RLIKE {_literal(LETTER)}, false)"),
    ("sendable", "t STRING", "BOOLEAN", f"coalesce(NOT t RLIKE {_literal(silent_pattern())}, false)"),
    ("trim_ws", "t STRING", "STRING", f"regexp_replace(t, {_literal(EDGES)}, '')"),
    ("word_count", "t STRING", "BIGINT", f"CAST(coalesce(size(regexp_extract_all(t, {_literal(f'[^{SPACE}]+')}, 0)), 0) AS BIGINT)"),
    ("token_estimate", "t STRING", "BIGINT", "CASE WHEN coalesce(length(t), 0) = 0 THEN 0 ELSE greatest(1, length(t) DIV 4) END"),
    ("language_code", "language STRING", "STRING", "lower(left(language, 2))"),
)


def register(spark: SparkSession) -> None:
    for name, parameters, kind, expression in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression}")
    spark.udtf.register("html_blocks", HtmlBlocks)
