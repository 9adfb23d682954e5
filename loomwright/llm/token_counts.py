"""Token counts by a digest cache.

Texts are brought to the tokenizer's own normal form; that and the tokenizer's version are reduced to SHA-256
digests. Counts already stored under a pair of digests are joined; only distinct misses are encoded, and
their counts are appended to the cache, a Parquet folder with a part for each tokenizer version.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .common import begin, fresh_path, join_hot_apart, rows_of, stored, text_or_empty
from .tokenizer_files import TokenizerFile

CACHE = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokenizer", T.StringType())])
SEEN = 500_000  # digests that a task remembers


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version: content, n_tokens; empty if nothing is stored. Only that
    version's part is read. A repeated append (say, by a job run twice) doesn't repeat rows here."""
    try:
        kept = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = spark.createDataFrame([], CACHE)
    return kept.filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def normaliser(tokenizer: TokenizerFile):
    """What tells texts with different ids apart: a function from a text to the bytes that the library works on.
    A text that holds an added token's string is kept as it is, as those are found before normalising."""
    t = tokenizer.load()
    if tokenizer.kind == "model":
        return lambda texts: [x.encode() for x in t.normalize(texts)]
    import json

    added = [x["content"] for x in json.loads(t.to_str())["added_tokens"]]
    normal = t.normalizer.normalize_str if t.normalizer else lambda x: x
    return lambda texts: [b"as it is " + x.encode() if any(a in x for a in added) else b"normal " + normal(x).encode() for x in texts]


def _digest(tokenizer: TokenizerFile):
    """id, n_bytes and the digest of the normalised content of each row."""

    def run(batches):
        begin()
        normal = normaliser(tokenizer)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                texts = b.column("text").to_pylist()
                contents = [hashlib.sha256(x).digest() for x in normal(texts)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(contents, pa.binary())], names=["id", "n_bytes", "content"])

    return run


def _distinct(tokenizer: TokenizerFile):
    """content and text, once for each content that a task remembers."""

    def run(batches):
        begin()
        normal, seen = normaliser(tokenizer), set()
        for (texts,) in rows_of(batches, "text"):
            for k in range(0, len(texts), 1000):
                own = texts[k : k + 1000]
                rows = []
                for content, text in zip((hashlib.sha256(x).digest() for x in normal(own)), own, strict=True):
                    if content not in seen:
                        seen.add(content)
                        rows.append((content, text))
                if len(seen) > SEEN:
                    seen.clear()
                if rows:
                    contents, kept = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(contents, pa.binary()), pa.array(kept, pa.string())], names=["content", "text"])

    return run


def _encoder(tokenizer: TokenizerFile):
    def encode(batches):
        t = tokenizer.load()
        for contents, texts in rows_of(batches, "content", "text"):
            for k in range(0, len(texts), 256):
                part = texts[k : k + 256]
                if tokenizer.kind == "model":
                    counts = [len(x) for x in t.encode(part, num_threads=1)]
                else:
                    counts = [len(x.ids) for x in t.encode_batch_fast(part, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([pa.array(contents[k : k + 256], pa.binary()), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return encode


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Texts are counted whole, without begin, end or added special tokens; a null text counts as empty. Texts
    with one normal form under the tokenizer have the same ids, so they share an entry of the cache;
    n_bytes is that of the text as given. Repeated rows and null ids give a row each; other columns,
    whatever their names, aren't read. An empty table gives no rows. The call encodes the misses and appends
    them to ``cache_path`` at once. Copies meet as one row a task before they are shuffled, and the counts of
    hot contents are broadcast, so the rows of a hot text stay where they are.
    """
    spark = docs.sparkSession
    tokenizer = TokenizerFile(spark, tokenizer_path)
    if tokenizer.kind == "tiktoken":
        raise ValueError("token_counts takes .json and .model files")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    short = T.StructType([base.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("content", T.BinaryType())])
    rows = stored(base.mapInArrow(_digest(tokenizer), short), "token-rows")
    distinct = base.select("text").mapInArrow(_distinct(tokenizer), "content binary, text string").groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache_path, tokenizer.version), "content", "left_anti")
    counted = misses.mapInArrow(_encoder(tokenizer), "content binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(tokenizer.version)).write.mode("append").partitionBy("tokenizer").option("compression", "zstd").parquet(cache_path)
    joined = join_hot_apart(rows, read_cache(spark, cache_path, tokenizer.version), ["content"])
    return joined.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, from an empty cache of its own: each call does the whole work."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), fresh_path(spark, "token-cache"))
