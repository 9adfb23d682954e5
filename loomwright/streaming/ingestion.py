"""Incremental ingestion: a stream's new rows appended to a store of segments, each with Bloom filters of its keys, so
that a batch reads only what may hold its keys."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled

BUCKETS, BITS_A_KEY, PROBES = 16, 16, 4


def _places(keys, bits: int):
    """The PROBES bits of each 64-bit key in a filter of ``bits`` (a power of two) bits."""
    import numpy as np

    h = keys.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)]


def bloom(keys) -> bytes:
    """A filter of some 64-bit keys, at least BITS_A_KEY bits each: about 1 in 400 others pass."""
    import numpy as np

    bits = max(1024, 1 << int(BITS_A_KEY * len(keys) - 1).bit_length())
    out = np.zeros(bits, bool)
    for at in _places(keys, bits):
        out[at] = True
    return np.packbits(out, bitorder="little").tobytes()


def may_hold(filter_: bytes, keys):
    """Which of the keys the filter lets pass; all that it was made of do."""
    import numpy as np

    own = np.frombuffer(filter_, np.uint8)
    passed = np.ones(len(keys), bool)
    for at in _places(keys, 8 * len(own)):
        passed &= own[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
    return passed


def _filters_of(rows: DataFrame) -> DataFrame:
    """bucket, bits, n from bucket and h (a hash of the key)."""

    def one(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy()
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([bloom(h)], pa.binary()), "n": pa.array([len(h)], pa.int64())})

    return rows.groupBy("bucket").applyInArrow(one, "bucket int, bits binary, n long")


def _touched(rows: DataFrame, filters: DataFrame) -> list:
    """The (segment, bucket) whose filter lets at least one of the rows' keys (bucket, h) pass."""

    def one(keys: pa.Table, own: pa.Table) -> pa.Table:
        h = keys.column("h").to_numpy()
        hit = [bool(len(h)) and bool(may_hold(bits.as_py(), h).any()) for bits in own.column("bits")]
        return own.select(["segment", "bucket"]).filter(pa.array(hit, pa.bool_()))

    return rows.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(one, "segment string, bucket int").collect()  # at most one row for each part of the store


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(batch: DataFrame, store: str, segment: str, key: str = "chunk_id", buckets: int = BUCKETS) -> dict:
    """Append the rows of ``batch`` whose key the store doesn't have, one for each key, as ``segment``, and return what was
    done: rows that came, rows that were new, the store's parts (segment and bucket) and how many of these were
    read. A segment that is there already (a batch that runs again) is written anew from the same rows, so nothing
    is added twice or lost. Rows with a null key are dropped. Writers to one store take turns."""
    spark = batch.sparkSession
    h = F.xxhash64(F.col(key).cast("string"))
    rows = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_h", h).withColumn("bucket", F.pmod("_h", F.lit(buckets)).cast("int"))
    rows = settled(rows, "ingest")
    came, parts, touched, new = rows.count(), 0, [], rows
    if _exists(spark, f"{store}/_filters"):
        filters = spark.read.schema("bucket int, bits binary, n long, segment string").parquet(f"{store}/_filters").filter(F.col("segment") != segment)
        parts = filters.count()
        touched = _touched(rows.select("bucket", F.col("_h").alias("h")), filters.select("segment", "bucket", "bits"))
        if touched:
            there = spark.read.parquet(*[f"{store}/segment={r.segment}/bucket={r.bucket}" for r in touched]).select(key)
            new = settled(rows.join(there, key, "left_anti"), "ingest")
    new.drop("_h").write.partitionBy("bucket").mode("overwrite").parquet(f"{store}/segment={segment}")
    _filters_of(new.select("bucket", F.col("_h").alias("h"))).write.mode("overwrite").parquet(f"{store}/_filters/segment={segment}")
    return {"segment": segment, "came": came, "new": new.count(), "parts": parts, "read": len(touched)}


def ingest(incoming: DataFrame, store: str, checkpoint: str, key: str = "chunk_id", report=None):
    """Append a stream's new rows to a Parquet store by ``append_new``, a segment for each batch. Runs over what is
    available and stops. ``report`` gets what was done in each batch."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        done = append_new(batch, store, f"{run}-{number:09d}", key)
        if report:
            report(done)

    return incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
