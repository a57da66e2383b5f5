"""A training corpus from raw documents: reject toxic texts, boilerplate, copies and benchmark leaks, then pack.

Every stage reads all that its predecessor kept, from a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.decontaminate import without_contaminated
from corvane.llm.line_dedup import remove_boilerplate
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.packing import pack
from corvane.llm.scratch import written
from corvane.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go.

    Null and empty texts are scored like any other, rows without doc_id too; repeated rows go or stay together; without
    labels nothing goes; no rows give no rows.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share stay once; documents that were nothing else go.

    Null and empty texts stay as they are, a null source counts as none, rows without doc_id are never the first to hold a
    line; n_chars, if there, follows the text where lines went. Columns named n_lines or n_removed stay the caller's.
    """
    own = {c: f"caller_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = remove_boilerplate(docs.withColumnsRenamed(own))
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    out = out.filter(~emptied)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays.

    Null, empty and blank texts and rows without doc_id link with nothing and stay; rows that share a doc_id are one
    document, so repeated rows stay or go together.
    """
    gone = near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go.

    Null and empty texts cover nothing and stay, null and blank items are covered by nothing.
    """
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training sequences: a row for each piece.

    Null and empty texts are their end token alone; repeated rows and rows without doc_id are packed each on its own.
    """
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: No SQL expresses the trained classifier or the tokenizer; the tests hold what each stage keeps against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
