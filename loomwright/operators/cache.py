"""The answer cache as a table: exact lookups by hash, semantic lookups by cosine, upserts, expiry."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from .relational import fresh_rows, newest_per_key, upserted

SCOPE = ["organization_id", "namespace", "user_id", "role"]


def with_hash(df: DataFrame, query_col: str = "query_text") -> DataFrame:
    return df.withColumn("query_hash", X.cache_hash(*(F.col(c) for c in SCOPE), F.col(query_col)))


def exact_hits(requests: DataFrame, cache: DataFrame, as_of: datetime.datetime, ttl: int) -> DataFrame:
    live = fresh_rows(cache, as_of, ttl).select("query_hash", "answer")
    return with_hash(requests).join(live, "query_hash").select("request_id", "answer", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))


def semantic_hits(requests: DataFrame, cache: DataFrame, as_of: datetime.datetime, ttl: int, threshold: float = 0.9, pool: int = 200, most_requests: int = 50_000) -> DataFrame:
    """Of the scope's ``pool`` newest live entries the most similar, if similar enough; ties go to the smaller hash.

    A scope's entries are one row, which each of its requests meets; requests are counted by scope, and a scope with more
    than ``most_requests`` is spread by a salt for which its row is repeated, so no task gets all requests of a hot one."""
    live = newest_per_key(fresh_rows(cache, as_of, ttl).filter("query_embedding is not null"), SCOPE, [F.col("created_at").desc(), F.col("query_hash")], pool)
    packs = live.groupBy(*SCOPE).agg(F.array_sort(F.collect_list(F.struct("query_hash", "query_embedding", "answer"))).alias("_pack"))  # at most ``pool`` entries
    asked = requests.select("request_id", *SCOPE, "query_embedding").filter("query_embedding is not null")
    salts = asked.groupBy(*SCOPE).agg(F.ceil(F.count("*") / most_requests).cast("int").alias("_salts"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in SCOPE])
    dealt = packs.alias("p").join(salts.alias("s"), same("p", "s")).select("p.*", "_salts", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    few = salts.filter("_salts > 1")  # at most all requests / most_requests
    placed = asked.alias("a").join(F.broadcast(few.alias("s")), same("a", "s"), "left").select("a.*", F.pmod(F.xxhash64("request_id"), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt"))
    met = placed.alias("a").join(dealt.alias("d"), same("a", "d") & (F.col("a._salt") == F.col("d._salt"))).select("request_id", "query_embedding", "_pack")
    similar = F.transform("_pack", lambda e: F.struct(V.cosine(F.col("query_embedding"), e["query_embedding"]).alias("similarity"), e["answer"].alias("answer")))
    none = F.struct(F.lit(float("-inf")).alias("similarity"), F.lit(None).cast(dict(cache.dtypes)["answer"]).alias("answer"))
    best = met.select("request_id", F.aggregate(similar, none, lambda best, e: F.when(e["similarity"] > best["similarity"], e).otherwise(best)).alias("best"))
    return best.filter(F.col("best.similarity") >= threshold).select("request_id", "best.answer", F.lit("semantic").alias("kind"), "best.similarity")


def lookup(requests: DataFrame, cache: DataFrame, as_of: datetime.datetime, ttl: int = 1800, threshold: float = 0.9) -> DataFrame:
    """Exact hits first; only what they miss is looked up by similarity."""
    exact = exact_hits(requests, cache, as_of, ttl)
    rest = requests.join(exact.select("request_id"), "request_id", "left_anti")
    return exact.unionByName(semantic_hits(rest, cache, as_of, ttl, threshold))


def stored(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache after an upsert; hits of known entries are kept."""
    return upserted(cache, entries, ["organization_id", "namespace", "query_hash"], keep=("hits",))


def expired(cache: DataFrame, as_of: datetime.datetime, ttl: int) -> DataFrame:
    return cache.filter(~(F.col("created_at") > F.lit(as_of - datetime.timedelta(seconds=ttl))))


def cleared(cache: DataFrame, organization: str, namespace: str) -> DataFrame:
    return cache.filter(~((F.col("organization_id") == organization) & (F.col("namespace") == namespace)))


def least_recent_out(cache: DataFrame, capacity: int) -> DataFrame:
    """Each scope's ``capacity`` entries used last."""
    return newest_per_key(cache, ["organization_id", "namespace"], [F.col("last_accessed").desc(), F.col("query_hash")], capacity)
