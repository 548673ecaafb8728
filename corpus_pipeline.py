"""A training corpus in five stages: toxicity, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.llm.common import stored, table
from benchloom.llm.decontamination import without_benchmark
from benchloom.llm.line_dedup import LONG_WORDS, without_recurring_lines
from benchloom.llm.packing import pack
from benchloom.llm.simhash_dedup import keep_one
from benchloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, long equal ones from two documents on; a document of which nothing is left goes too.  ``n_chars`` follows the text."""
    cut = without_recurring_lines(docs, long_words=LONG_WORDS)
    emptied = (F.col("__dropped") > 0) & (F.trim(F.col("text")) == "")
    left = cut.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("__dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: three-word shingles, fingerprints at most two bits apart."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("simhash dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier chain and the tokenizer have no form in SQL.  tests/llm checks the columns and ids of the stages and
#: the operators, near-dedup against brute force; no test checks the whole result.
ORACLE_SQL = None
