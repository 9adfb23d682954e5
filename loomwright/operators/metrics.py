"""Metrics: percentiles, rates, health, dashboards, guard counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles
from .relational import newest_per_key


SHARES = (50, 90, 95, 99)


def metric_stats(metrics: DataFrame, last: int | None = None) -> DataFrame:
    """metrics(name, seq, value): count, mean, population deviation, extremes and exact interpolated percentiles
    of each name, over its last rows if ``last`` is given (these few are sorted in place)."""
    plain = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most")]
    if last:
        rows = newest_per_key(metrics, ["name"], [F.col("seq").desc()], last)
        return rows.groupBy("name").agg(*plain, *[F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in SHARES])
    named = metrics.withColumn("_null", F.col("name").isNull()).withColumn("_name", F.coalesce("name", F.lit("")))  # a null name is a group
    exact = percentiles(named, ["_name", "_null"], "value", [p / 100 for p in SHARES]).drop("n")
    stats = named.groupBy("_name", "_null").agg(F.first("name").alias("name"), *plain)
    return stats.join(exact, ["_name", "_null"], "left").select("name", "n", "mean", "std", "least", "most", *[F.col(f"p_{k}").alias(f"p{p}") for k, p in enumerate(SHARES)])


def tool_latencies(calls: DataFrame, last: int = 100) -> DataFrame:
    return metric_stats(calls, last).drop("std", "p90")


def health(requests: DataFrame) -> DataFrame:
    """requests(latency, cost, cache_hit, error)."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")) * 100, F.lit(0.0))
    p95 = percentiles(requests, [], "latency", [0.95]).agg(F.max("p_0").alias("p95_latency"))  # one row, null without latencies
    return requests.agg(F.count("*").alias("requests"), F.avg("latency").alias("avg_latency"), F.avg("cost").alias("cost_per_query"), share("cache_hit").alias("cache_hit_pct"), share("error").alias("error_pct")).crossJoin(F.broadcast(p95))


def dashboard(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, hits, mean latency and hit rate; zeros where there is nothing."""
    n, hits = F.count("*"), F.count_if(F.col("cache_hit"))
    return requests.groupBy(*(by or [])).agg(n.alias("total"), hits.alias("hits"), F.coalesce(F.avg("latency"), F.lit(0.0)).alias("avg_latency"), F.when(n > 0, hits / n).otherwise(0.0).alias("hit_rate"))


def engine_stats(requests: DataFrame) -> DataFrame:
    n = F.count("*")
    return requests.agg(F.count_if(~F.col("error")).alias("succeeded"), F.count_if("error").alias("failed"), F.when(n > 0, F.round(F.count_if("cache_hit") / n * 100, 1)).otherwise(0.0).alias("hit_rate"), F.coalesce(F.avg("latency"), F.lit(0.0)).alias("avg_latency"))


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits"), F.count("query_embedding").alias("with_embedding"), F.coalesce(F.round(F.avg("hits"), 2), F.lit(0.0)).alias("avg_hits"))


def memory_stats(messages: DataFrame) -> DataFrame:
    per_user = messages.groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.agg(F.count("*").alias("users"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_per_user"))


def memory_by_user(messages: DataFrame) -> DataFrame:
    return messages.groupBy("user_id").agg(F.count("*").alias("messages"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def guard_counters(verdicts: DataFrame) -> DataFrame:
    """verdicts(safe, reason, pii): how many of each outcome."""
    by = lambda *kinds: F.count_if(F.coalesce(F.col("reason").isin(*kinds), F.lit(False)))
    return verdicts.agg(
        F.count("*").alias("total"), F.count_if(~F.col("safe")).alias("blocked"), by("prompt_injection", "jailbreak", "code_injection", "sql_injection", "os_command").alias("injections"),
        by("too_short", "too_long").alias("length_violations"), by("rate_limit").alias("rate_limited"), by("sensitive").alias("sensitive_blocked"), F.count_if(F.size("pii") > 0).alias("pii_detected"),
    )


def ocr_pages(tokens: DataFrame, least: float) -> DataFrame:
    """tokens(page, seq, token, confidence): text of the tokens that are sure enough, in order, and their mean
    confidence. A page's tokens are bounded by the page."""
    sure = tokens.filter(F.col("confidence") >= least)
    return sure.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda t: t["token"]), " ").alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("tokens"))


def ocr_stats(runs: DataFrame) -> DataFrame:
    n = F.count("*")
    return runs.agg(n.alias("runs"), F.when(n > 0, F.count_if("ok") * 100 / n).otherwise(0.0).alias("success_pct"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"))
