"""Text predicates and scalar functions as columns. Character classes are written out once, so that Java and RE2 read them alike."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sized
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that Python's str.isspace accepts, as the inside of a regex class.
SPACE = "\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
EDGES = f"^[{SPACE}]+|[{SPACE}]+$"
LETTER = "\\p{L}"
#: Punctuation that needs no translation.
PUNCTUATION = ".,;:!?@#$%^&*()[]{}/<>\\|=-_+~`'\""


@cache
def _digits() -> str:
    """Digits outside the category Nd, such as superscripts, as ranges of a regex class: found by rule, not listed."""
    found = [c for c in range(0x110000) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    starts = [c for i, c in enumerate(found) if i == 0 or found[i - 1] != c - 1]
    ends = [c for i, c in enumerate(found) if i == len(found) - 1 or found[i + 1] != c + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


def silent_pattern() -> str:
    """A text of nothing but white space, digits and punctuation: it passes through untranslated."""
    marks = "".join("\\" + c if c in "\\]^-[&~|" else c for c in PUNCTUATION)
    return f"^[\\p{{Nd}}{_digits()}{marks}{SPACE}]*$"


def trim_ws(text: Column) -> Column:
    """White space off both ends, in the sense of Python's strip()."""
    return F.regexp_replace(text, EDGES, "")


def blank(text: Column) -> Column:
    return F.coalesce(F.length(trim_ws(text)), F.lit(0)) == 0


def translatable(text: Column) -> Column:
    """Holds a letter. Null: false."""
    return F.coalesce(text.rlike(LETTER), F.lit(False))


def sendable(text: Column) -> Column:
    """Goes to a backend: neither null nor blank nor made of digits and punctuation alone. Not the same as translatable: a lone dash is sendable."""
    return F.coalesce(~text.rlike(silent_pattern()), F.lit(False))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least; 0 for empty and null."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def token_counter(encode: Callable[[str], Sized]) -> Callable[[Column], Column]:
    """A column function that counts tokens by `encode`, say a tokenizer's; it runs on Arrow batches in Python. Null: 0."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count


def scaled_estimate(length: Column, cap: int = 50_000) -> Column:
    """The estimate for a text of `length` characters, of which the first `cap` are counted and the rest scaled up."""
    n = F.coalesce(length, F.lit(0))
    short = F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4)))
    return F.when(n > cap, F.floor(F.lit(float(cap // 4)) * (n / F.lit(float(cap))))).otherwise(short).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))), F.lit(0)).cast("long")


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; empty without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


#: File kinds that are taken.
EXTENSIONS = ("epub", "pdf")


def output_name(name: Column, target: Column) -> Column:
    """stem_tradotto_language.ext; the stem keeps leading dots, and a name of one leading dot has no extension."""
    ext = F.regexp_extract(name, "^\\.*[^.].*(\\.[^.]*)$", 1)
    return F.concat(F.left(name, F.length(name) - F.length(ext)), F.lit("_tradotto_"), target, ext)


def language_code(language: Column) -> Column:
    """The first two letters, lower-cased. Not ISO: Spanish gives sp."""
    return F.lower(F.left(language, F.lit(2)))


def clean_answer(answer: Column) -> Column:
    """A backend's answer to what language a text is in: edges off, first line; null gives Unknown."""
    bare = F.regexp_replace(trim_ws(answer), "^[.'\"]+|[.'\"]+$", "")
    return F.coalesce(trim_ws(F.substring_index(bare, "\n", 1)), F.lit("Unknown"))


def clean_response(response: Column, source: Column) -> Column:
    """A backend's translation: edges off; an empty or null one leaves the source. A blank one becomes empty."""
    return F.when(F.length(F.coalesce(response, F.lit(""))) > 0, trim_ws(response)).otherwise(source)
