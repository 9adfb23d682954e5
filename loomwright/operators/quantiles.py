"""Exact percentiles of many groups at once, by selection: no task holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled

ACCURACY, SMALL_GROUP = 10_000, 100_000


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], accuracy: int = ACCURACY, small_group: int = SMALL_GROUP) -> DataFrame:
    """``by`` (may be empty), n, and the interpolated percentiles p_0, p_1, ... at ``shares``; null values don't count,
    NaN is above all numbers. Groups without values have no row.

    One pass gives every group a sketch of bounded size and from it, for each share, two values that the sought ranks
    surely lie between (whole groups of at most ``small_group`` rows). A second pass counts what is below and
    the distinct values in between, combined where they lie: some 4 / accuracy of a group, however its values are
    spread. Running counts over these give the ranks. Should a sketch be wrong, its group is counted whole.
    """
    own = rows.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    slack = 2 / accuracy
    near = [min(1.0, max(0.0, s + d)) for s in shares for d in (-slack, slack)]
    sketched = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", near, accuracy).alias("_near"))
    small = F.col("n") <= small_group
    spans = F.array(*[F.struct(F.lit(k).alias("k"), F.when(small, F.col("_least")).otherwise(F.col("_near")[2 * k]).alias("a"), F.when(small, F.col("_most")).otherwise(F.col("_near")[2 * k + 1]).alias("b"), (F.lit(s) * (F.col("n") - 1)).alias("at")) for k, s in enumerate(shares)])
    groups = settled(sketched.select(*by, "n", "_least", "_most", spans.alias("_spans")), "percentile-groups")
    found = settled(_selected(own, groups, by), "percentiles")
    wrong = found.filter("_low is null or _high is null").select(*by).distinct()
    if not wrong.isEmpty():
        whole = F.transform("_spans", lambda s: s.withField("a", F.col("_least")).withField("b", F.col("_most")))
        again = groups.join(wrong, by, "left_semi") if by else groups
        again = again.withColumn("_spans", whole)
        found = (found.join(wrong, by, "left_anti") if by else found.limit(0)).unionByName(_selected(own, again, by))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    exact = F.when(F.col("_part") == 0, F.col("_low")).otherwise(between)
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("_k") == k, exact)).alias(f"p_{k}") for k in range(len(shares))])


def _selected(own: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """by, n, _k (which share), _low and _high (the values of the ranks about it; null if not between the span's ends),
    _part (how far between them)."""
    spans = groups.select(*by, "_spans")
    met = own.join(spans, by) if by else own.crossJoin(F.broadcast(spans))  # one row
    # what is below a span becomes null, what is above it goes
    met = met.select(*by, F.explode(F.filter(F.transform("_spans", lambda s: F.struct(s["k"].alias("k"), (F.col("_v") > s["b"]).alias("above"), F.when(F.col("_v") >= s["a"], F.col("_v")).alias("v"))), lambda x: ~x["above"])).alias("_x"))
    counts = met.groupBy(*by, F.col("_x.k").alias("_k"), F.col("_x.v").alias("_v")).agg(F.count("*").alias("_m"))
    order = Window.partitionBy(*by, "_k").orderBy(F.col("_v").asc_nulls_first())
    running = counts.select(*by, "_k", "_v", F.sum("_m").over(order).alias("_to"), (F.sum("_m").over(order) - F.col("_m")).alias("_from"))
    wanted = groups.select(*by, "n", F.explode("_spans").alias("_s")).select(*by, "n", F.col("_s.k").alias("_k"), F.col("_s.at").alias("_at"))
    low, high = F.floor("_at"), F.ceil("_at")
    held = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))
    return wanted.join(running, [*by, "_k"]).groupBy(*by, "n", "_k", "_at").agg(held(low).alias("_low"), held(high).alias("_high")).withColumn("_part", F.col("_at") - F.floor("_at")).drop("_at")
