"""Conversation windows: the last messages, a token budget, compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, token_estimate
from .relational import newest_per_key

THRESHOLD, RECENT, MOST_SUMMARY, MOST_ENTRY, MOST_MESSAGES = 20, 6, 4000, 500, 500
# --- fixed values -----------------------------------------------------------
SUMMARY_HEAD = "[Summary of earlier conversation. This summary is extractive and contains only prior messages:]\n"
NO_SUMMARY = "[Earlier conversation history could not be summarized.]"
# ----------------------------------------------------------------------------


def last_messages(messages: DataFrame, n: int = 12, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    return newest_per_key(messages, [conv], [F.col(turn).desc()], n)


def within_budget(messages: DataFrame, budget: int, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """From the newest backwards while the tokens fit; a newest message that is too large alone is cut to the
    budget. Costs are positive, so the running sum stops at the first that overflows."""
    rows = messages.withColumn("tokens", token_estimate(F.col(text))).filter("tokens > 0")
    back = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    rows = rows.withColumn("_sum", F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(back))
    large = (F.col("_nth") == 1) & (F.col("tokens") > budget)
    cut = F.when(large, F.substring(F.col(text), 1, budget * 4)).otherwise(F.col(text))
    return rows.filter((F.col("_sum") <= budget) | large).withColumn(text, cut).withColumn("tokens", F.when(large, F.lit(budget)).otherwise(F.col("tokens"))).drop("_sum", "_nth")


def _end(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def _entries(messages: Column) -> Column:
    """A line for each message that says something: its role and its text, cut to 500 characters."""
    text = lambda m: F.regexp_replace(F.coalesce(m["text"], F.lit("")), r"^\s+|\s+$", "")
    cut = lambda t: F.when(F.length(t) > MOST_ENTRY, F.concat(_end(F.substring(t, 1, MOST_ENTRY)), F.lit("…"))).otherwise(t)
    told = F.filter(F.transform(messages, lambda m: F.struct(F.upper(F.coalesce(m["role"], F.lit("unknown"))).alias("role"), text(m).alias("text"))), lambda m: m["text"] != "")
    return F.transform(told, lambda m: F.concat(F.lit("- "), m["role"], F.lit(": "), cut(m["text"])))


def summary(messages: Column) -> Column:
    """An extractive summary of an array of (role, text) in order: entries up to and with the one that brings them to
    4000 characters (each counts one more for its line feed), then cut to 4000 with the head."""

    nothing = F.struct(F.lit("").alias("text"), F.lit(0).alias("size"))
    more = lambda s, x: F.struct(F.concat(s["text"], F.when(s["size"] > 0, "\n").otherwise(""), x).alias("text"), (s["size"] + F.length(x) + 1).alias("size"))
    lines = F.aggregate(_entries(messages), nothing, lambda s, x: F.when(s["size"] < MOST_SUMMARY, more(s, x)).otherwise(s), lambda s: s["text"])
    told = let(lines, lambda x: F.when(x == "", NO_SUMMARY).otherwise(F.concat(F.lit(SUMMARY_HEAD), x)))
    return let(told, lambda x: F.when(F.length(x) > MOST_SUMMARY, F.concat(_end(F.substring(x, 1, MOST_SUMMARY)), F.lit("…"))).otherwise(x))


def compressed(messages: DataFrame, threshold: int = THRESHOLD, recent: int = RECENT, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Histories of ``threshold`` messages or more become a summary of the earlier ones (a system message in the place
    of the first) and the ``recent`` last. Only the last 500 messages of a conversation are kept at all, so
    its array is bounded."""
    kept = newest_per_key(messages.select(conv, turn, "role", "text"), [conv], [F.col(turn).desc()], MOST_MESSAGES)
    history = kept.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "role", "text"))).alias("m"))
    early = F.slice("m", 1, F.size("m") - recent)
    first = F.struct(F.col("m")[0][turn].alias(turn), F.lit("system").alias("role"), summary(early).alias("text"))
    short = F.when(F.size("m") < threshold, F.col("m")).otherwise(F.concat(F.array(first), F.slice("m", F.size("m") - recent + 1, F.lit(recent))))
    return history.select(conv, F.inline(short)).select(*kept.columns)
