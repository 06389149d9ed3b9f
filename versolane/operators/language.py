"""Language samples, detection requests, and a native scorer by function words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import SAMPLE_SKIP, plain_text
from ..functions.text import trim_ws

ASK = "Which language is the following text in? Answer with its English name only.\n\n"
#: Frequent words of four languages.
PROFILE = {"en": ("the", "of", "and", "that", "is"), "fr": ("le", "les", "et", "est", "des", "dans"), "de": ("der", "die", "und", "das", "ist"), "es": ("el", "los", "y", "para", "una", "por")}


def chapter_sample(chapters: DataFrame) -> DataFrame:
    """(book_id, sample): of a book's first three chapters the first with over 50 characters of text, 1,000 at most; usable from 20 on."""
    # made as a generator's row, the text is worked out once and not again for the filter
    rows = chapters.where("doc_idx < 3").select("book_id", "doc_idx", F.explode(F.array(plain_text(F.col("html"), SAMPLE_SKIP))).alias("text"))
    rows = rows.where(F.length("text") > 50).groupBy("book_id").agg(F.min_by("text", "doc_idx").alias("text"))
    return rows.select("book_id", F.left("text", F.lit(1000)).alias("sample")).where(F.length(trim_ws(F.col("sample"))) >= 20)


def page_sample(pages: DataFrame) -> DataFrame:
    """(book_id, sample): the first 1,000 characters of a book's first page; usable from 20 on."""
    rows = pages.where("page_no = 0").select("book_id", F.left("text", F.lit(1000)).alias("sample"))
    return rows.where(F.length(trim_ws(F.col("sample"))) >= 20)


def detection_requests(samples: DataFrame, jobs: DataFrame, providers: DataFrame, detection: dict[str, str]) -> DataFrame:
    """(job_id, provider, model, prompt): each sample as a request. A blank provider becomes the first that is available; a blank model that provider's default. Jobs without any provider are left out."""
    up = F.broadcast(providers.agg(F.max(F.when((F.col("provider") == "anthropic") & F.col("available"), True)).alias("a"), F.max(F.when((F.col("provider") == "openai") & F.col("available"), True)).alias("o")))
    rows = samples.join(jobs, "job_id").crossJoin(up)  # one row
    provider = F.coalesce(F.nullif("provider", F.lit("")), F.when(F.col("a"), "anthropic").when(F.col("o"), "openai"))
    rows = rows.withColumn("provider", provider).where(F.col("provider").isNotNull())
    default = F.when(F.col("provider") == "anthropic", detection["anthropic"]).otherwise(detection["openai"])
    return rows.select("job_id", "provider", F.coalesce(F.nullif("model", F.lit("")), default).alias("model"), F.concat(F.lit(ASK), F.left("sample", F.lit(1000))).alias("prompt"))


def score(text: Column) -> Column:
    """The language whose function words are most frequent in the text; ties go to the greater code; without any, Unknown."""
    count = lambda low, own: F.regexp_count(low, F.lit(f"(?<!\\p{{L}})(?:{'|'.join(own)})(?!\\p{{L}})"))
    best = lambda low: F.array_max(F.array(*[F.struct(count(low, own).alias("n"), F.lit(code).alias("code")) for code, own in PROFILE.items()]))
    named = lambda b: F.when(F.coalesce(b["n"], F.lit(0)) > 0, b["code"]).otherwise("Unknown")
    # as one-element arrays, the lower-cased text and the best language are worked out once
    return F.element_at(F.transform(F.transform(F.array(F.lower(text)), best), named), 1)
