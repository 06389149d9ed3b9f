"""Translatable blocks of HTML: which elements they are, which are leaves, and how translations go back into the page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import BLOCK, INLINE, SKIP, VOID


class _Blocks(HTMLParser):
    """Collects elements with their places in the source. An end tag closes up to the nearest open tag of its name; one without is ignored."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)  # without it the parser ends at "&#" that no number follows
        self.found, self.open, self.clock = [], [], 0
        starts, at = [0], 0
        for line in source.split("\n"):
            at += len(line) + 1
            starts.append(at)
        self.starts, self.source = starts, source
        self.feed(source)
        self.close()
        while self.open:
            self._end(len(source))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _begin(self, tag: str, after: int) -> None:
        self.clock += 1
        if self.open and tag not in INLINE and tag not in SKIP:
            self.open[-1]["inline"] = False
        skipped = tag in SKIP or any(x["skip"] for x in self.open[-1:])
        self.open.append({"tag": tag, "pre": self.clock, "begin": after, "inline": True, "skip": skipped, "leaf": True})

    def _end(self, at: int) -> None:
        x = self.open.pop()
        self.clock += 1
        own = False
        if x["tag"] in BLOCK and x["inline"] and not x["skip"]:
            inner = self.source[x["begin"] : at]
            if any(c.isalpha() for c in inner):
                self.found.append((x["pre"], self.clock, x["tag"], x["begin"], at, inner, x["leaf"]))
                own = True
        if self.open and (own or not x["leaf"]):
            self.open[-1]["leaf"] = False

    def handle_starttag(self, tag, attrs):
        after = self._at() + len(self.get_starttag_text() or "")
        self._begin(tag, after)
        if tag in VOID:
            self._end(after)

    def handle_startendtag(self, tag, attrs):
        after = self._at() + len(self.get_starttag_text() or "")
        self._begin(tag, after)
        self._end(after)

    def handle_endtag(self, tag):
        if any(x["tag"] == tag for x in self.open):
            at = self._at()
            while self.open[-1]["tag"] != tag:
                self._end(at)
            self._end(at)


def find(source: str | None) -> list[tuple]:
    """(pre, post, tag, begin, end, inner, leaf) of the candidate blocks of a page, in document order; a leaf holds no other candidate."""
    return sorted(_Blocks(source or "").found)


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block_no, tag, pre, post, begin, end, inner_html, leaf): block elements outside skipped ones, with inline children only, whose markup holds a letter."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, source in zip(batch["key"], batch["html"]):
                rows = find(source)
                if rows:
                    yield pd.DataFrame([(k, i, tag, pre, post, a, b, inner, leaf) for i, (pre, post, tag, a, b, inner, leaf) in enumerate(rows)], columns=["key", "block_no", "tag", "pre", "post", "begin", "end", "inner_html", "leaf"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return rows.mapInPandas(run, f"key {kind}, block_no int, tag string, pre int, post int, begin int, end int, inner_html string, leaf boolean").withColumnRenamed("key", key)


def leaves(found: DataFrame) -> DataFrame:
    """Candidates that hold no other candidate, as the parser saw them."""
    return found.where("leaf")


def splice(pages: DataFrame, done: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, html): each page with the inner HTML of its blocks replaced by `done` (key, begin, end, translated); tags and attributes stay. Built in: pieces of the source between the places."""
    parts = done.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_list(F.struct("begin", "end", "translated"))).alias("p"))
    rows = pages.select(key, html).join(parts, F.col(key) == F.col("k"), "left")
    before = lambda x, i: F.substring(F.col(html), F.when(i == 0, F.lit(1)).otherwise(F.get("p", i - 1)["end"] + 1), x["begin"] - F.when(i == 0, F.lit(0)).otherwise(F.get("p", i - 1)["end"]))
    body = F.array_join(F.transform("p", lambda x, i: F.concat(before(x, i), x["translated"])), "")
    tail = F.substring(F.col(html), F.element_at("p", -1)["end"] + 1, F.length(html))
    return rows.select(key, F.when(F.col("p").isNull(), F.col(html)).otherwise(F.concat(body, tail)).alias(html))


def plain(inner: str) -> str:
    """A translated block's text as the next block's context: tags off, characters decoded, nothing trimmed."""
    out: list[str] = []
    parser = HTMLParser(convert_charrefs=True)
    parser.handle_data = out.append
    parser.feed(inner)
    parser.close()
    return "".join(out)
