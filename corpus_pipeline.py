"""The training-data pipeline over `documents`: each stage is one operator of versolane.llm, applied to what the stage before kept.

STAGES' functions take (spark, docs, sf_dir). All but the last return the columns of `documents`; the last returns packed pieces with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versolane.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from versolane.llm.common import read, saved
from versolane.llm.queries import tokenizer


#: A benchmark item of fewer words is no evidence of a leak: its words stand in clean documents too.
EVIDENCE = 5


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose probability of any toxicity grade is a half or more go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def boilerplate_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lines that many documents of their source hold are cut out; n_chars follows the text. Every document stays."""
    aside = {c: f"__{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}  # the operator's own columns have these names
    cut = line_dedup.drop_boilerplate(docs.withColumnsRenamed(aside))
    length = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[length.alias(c) if c == "n_chars" else F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near-duplicates (five words, 80 per cent) stays, that with the smallest doc_id."""
    found = near_dedup.near_duplicates(docs, percent=80)
    return docs.join(found.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that overlap a benchmark item go; EVIDENCE words of it have to be compared, so items below that drop nothing."""
    found = decontaminate.matches(docs, read(spark, sf_dir, "benchmark"))
    return docs.join(found.where(F.col("span") >= EVIDENCE).select(F.col("key").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the kept documents as pieces of full sequences with their ids, by sequence; neighbours on the curve side by side."""
    return packing.pack(docs, tokenizer())


STAGES = [("toxicity", toxic_out), ("line_dedup", boilerplate_out), ("near_dedup", near_copies_out), ("decontamination", leaks_out), ("packing", packed)]

#: The first and third stage are no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
