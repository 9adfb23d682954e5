"""Sharding by a k-d tree over what is known of each text.

Starting from one node, a node that is to become k shards is split at a weighted median (weight:
bytes) of its widest dimension, k // 2 : k - k // 2, until each leaf is one shard of the target
bytes. All medians of a level are found together by histograms over the stored features, refined
until they are exact; the driver gets a row for each node.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_or_empty

BINS, SLOT_BUCKETS, STORED_LEVELS = 1024, 64, 5
MOST_BROADCAST = 500_000  # rows of three numbers


def text_features(text: Column) -> dict[str, Column]:
    """Dimensions that follow from the text alone, so that equal texts never part: bytes, characters,
    spaces and lines."""
    return {
        "d_bytes": F.octet_length(text).cast("long"),
        "d_chars": F.length(text).cast("long"),
        "d_words": (F.length(text) - F.length(F.translate(text, " ", ""))).cast("long"),
        "d_lines": (F.length(text) - F.length(F.translate(text, "\n", ""))).cast("long"),
    }


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each node, as a literal; broadcast, it is as small as the list that the driver holds."""
    fields = [c.split() for c in schema.split(", ")]
    data = json.dumps([{n: x for (n, _), x in zip(fields, r, strict=True)} for r in rows])
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{','.join(map(':'.join, fields))}>>"))))


def _value(dims: list[str]) -> Column:
    """A row's value in its node's dimension (``_dim``)."""
    value = F.col(dims[-1])
    for k in range(len(dims) - 2, -1, -1):
        value = F.when(F.col("_dim") == k, F.col(dims[k])).otherwise(value)
    return value


def place(rows: DataFrame, dims: list[str], n_shards: int, weight: str = "size", tie: str = "tie", stored_levels: int = STORED_LEVELS) -> DataFrame:
    """Stored ``rows`` with ``node``, the first shard of their leaf of the tree: rows have long columns ``dims``, a
    long ``tie`` for rows equal in a dimension, and a positive long ``weight``. Rows equal in all of these share a
    leaf. A node whose rows can't be told apart stays whole and its other shards stay empty. What is known of the
    nodes is joined as a table, so the plan doesn't grow with them; every few levels the nodes are stored."""
    spark = rows.sparkSession
    placed = rows.withColumn("node", F.lit(0).cast("long"))
    world = rows.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    if world[0] is None:
        return placed
    span = {d: max(1, world[f"hi_{d}"] - world[f"lo_{d}"]) for d in dims}
    open_, level = {0: n_shards} if n_shards > 1 else {}, 0
    while open_:
        own = placed.join(_table(spark, [(n,) for n in open_], "node bigint"), "node", "left_semi")
        facts = own.groupBy("node").agg(F.sum(weight).alias("w"), *[f(d).alias(f"{n}_{d}") for d in [*dims, tie] for n, f in (("lo", F.min), ("hi", F.max))]).collect()  # a row for each node
        goals = {}
        for f in facts:
            shards = open_[f["node"]]
            widest = max(dims, key=lambda d: ((f[f"hi_{d}"] - f[f"lo_{d}"]) / span[d], -dims.index(d)))
            if f[f"hi_{widest}"] > f[f"lo_{widest}"] or f[f"hi_{tie}"] > f[f"lo_{tie}"]:
                goals[f["node"]] = {"dim": dims.index(widest), "least": -(-f["w"] * (shards // 2) // shards), "below": 0, "lo": f[f"lo_{widest}"], "hi": f[f"hi_{widest}"]}
        _narrow(own, goals, dims, None, weight, tie)
        values = {n: g["lo"] for n, g in goals.items()}
        for g in goals.values():
            g |= {"lo": None, "hi": None}
        _narrow(own, goals, dims, values, weight, tie)
        splits = _table(spark, [(n, g["dim"], values[n], g["lo"], n + open_[n] // 2) for n, g in goals.items()], "node bigint, _dim int, _value bigint, _tie bigint, _high bigint")
        high = (_value(dims) > F.col("_value")) | ((_value(dims) == F.col("_value")) & (F.col(tie) > F.col("_tie")))
        placed = placed.join(splits, "node", "left").withColumn("node", F.when(F.col("_high").isNotNull() & high, F.col("_high")).otherwise(F.col("node"))).select(*placed.columns)
        open_ = {n: k for first in goals for n, k in ((first, open_[first] // 2), (first + open_[first] // 2, open_[first] - open_[first] // 2)) if k > 1}
        level += 1
        if level % stored_levels == 0 and open_:
            placed = stored(placed, "shard-nodes")
    return placed


def _narrow(own: DataFrame, goals: dict, dims: list[str], values: dict | None, weight: str, tie: str) -> None:
    """Narrow each node's [lo, hi] to the least value (or, with ``values``, the least tie at that value) at which
    the running weight reaches its goal."""
    while todo := {n: g for n, g in goals.items() if g["lo"] is None or g["lo"] < g["hi"]}:
        rows = []
        for n, g in todo.items():  # without a range yet: one bin
            lo, hi = (-(2**62), 2**62) if g["lo"] is None else (g["lo"], g["hi"])
            rows.append((n, g["dim"], None if values is None else values[n], lo, hi, 2**62 if g["lo"] is None else (hi - lo) // BINS + 1, g["least"] - g["below"]))
        table = _table(own.sparkSession, rows, "node bigint, _dim int, _value bigint, _lo bigint, _hi bigint, _step bigint, _least bigint")
        key = _value(dims) if values is None else F.col(tie)
        inside = key.between(F.col("_lo"), F.col("_hi"))
        if values is not None:
            inside = inside & (_value(dims) == F.col("_value"))
        binned = own.join(table, "node").filter(inside).select("node", "_least", weight, key.alias("_key"), "_lo", "_step").withColumn("_bin", F.expr(f"CASE WHEN _step = {2**62} THEN 0 ELSE (_key - _lo) div _step END"))
        hist = binned.groupBy("node", "_least", "_bin").agg(F.sum(weight).alias("w"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))
        run = F.sum("w").over(Window.partitionBy("node").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        reached = hist.withColumn("run", run).filter(F.col("run") >= F.col("_least"))
        for r in reached.groupBy("node").agg(F.min(F.struct("_bin", "run", "w", "lo", "hi")).alias("m")).select("node", "m.*").collect():  # a row for each node
            g = todo[r["node"]]
            g |= {"below": g["below"] + r["run"] - r["w"], "lo": r["lo"], "hi": r["hi"]}


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", slot_buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, size (UTF-8 bytes plus 1), text_crc32, law ("bytes": the
    shards' sizes are near equal), shard, slot (gapless from 0 in each shard), grown_shard (null).

    Give ``n_shards`` or the ``target_bytes`` of a shard. Equal texts share a shard; a null text counts as empty.
    Null and repeated ids and repeated rows get a slot each; other columns aren't read; an empty table gives
    no rows. Sizes can differ by what can't be parted: a group of equal texts. Texts are read once; the
    shuffle for the slots has ids and numbers only, dealt by shard and a bucket of the id (by default one for
    each 500,000 rows of an average shard, 64 at least; null ids are spread), so a hot text's slots are numbered
    by many tasks. The driver gets a row for each node of a level.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    features = text_features(F.col("text"))
    whole = lambda c, n: F.conv(F.substring(F.md5(c.cast("binary")), 1, n), 16, 10).cast("long")
    own = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(whole(F.col("id").cast("string"), 7))
    rows = stored(base.select("id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), whole(F.col("text"), 15).alias("tie"), own.alias("own"), *[c.alias(n) for n, c in features.items()]), "shard-features")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    if n_shards < 1:
        raise ValueError("at least one shard")
    buckets = slot_buckets or max(SLOT_BUCKETS, -(-n // (n_shards * 500_000)))
    placed = place(rows, list(features), n_shards).select("id", "size", "crc", "tie", F.pmod("own", F.lit(buckets)).cast("int").alias("bucket"), F.col("node").cast("int").alias("shard"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    begins = stored(counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("begin")), "shard-begins")
    few = begins.count() <= MOST_BROADCAST
    order = Window.partitionBy("shard", "bucket").orderBy("tie", F.col("id").asc_nulls_first())
    return placed.withColumn("nth", F.row_number().over(order)).join(F.broadcast(begins) if few else begins, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_shards=16)
