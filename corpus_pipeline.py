"""From raw documents to packed sequences: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` applies them in order, each to what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import fresh, stored
from loomwright.llm.line_templates import drop_recurring_lines
from loomwright.llm.ngram_join import keep_one_of_each
from loomwright.llm.packing import pack
from loomwright.llm.quality import fit, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, rejects (low quality or toxic) go. A null text is judged
    as an empty one; null sources and languages are sites of their own; repeated rows are judged each and alike;
    an empty table stays empty."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for one document each; a document with nothing but white space left
    goes too. Null, empty and blank texts have no such lines and stay as they are, as do rows with null ids
    unless another document keeps the lines; documents with equal texts are one document, so copies are treated
    alike (of equal ids, the text with the smaller hash keeps the lines)."""
    n, gone = fresh(docs, "_lines"), fresh(docs, "_dropped")
    out = drop_recurring_lines(docs, counts=(n, gone)).filter((F.col(gone) == 0) | F.col("text").rlike(r"\S"))
    chars = F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: five words, a similarity of 0.75. That with the smallest id
    (null ids last); of rows that repeat id and text, one. Documents without words, null texts too, all stay."""
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens, in the sources' proportions. A null or empty text
    has its end token; null sources are one source; repeated rows and null ids are documents of their own."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", packing)]

#: The classifier can't be expressed in SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
