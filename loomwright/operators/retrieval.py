"""Retrieval: exact kNN, BM25, fusion, reranking, boosts, citations, answers."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from .bm25 import BM25Index, StoredIndex  # noqa: F401
from .knn import nearest
from .relational import scoped

MOST_TOP_K, MOST_QUERIES = 100, 100
RRF_K = 60


def top_k_of(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError("top_k must be a positive integer")
    return min(k, MOST_TOP_K)


def ranked(df: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best ``k`` of each query, with their rank; a task passes on at most k rows a query."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pool_of(k: int) -> int:
    """How many candidates each list gives before fusion: three for each result, 100 at most."""
    return min(3 * top_k_of(k), MOST_TOP_K)


def in_blocks(queries: DataFrame, by: str, run) -> DataFrame:
    """``run`` of the queries in blocks of about 100, one after another (one block if they are no more)."""
    blocks = -(-queries.count() // MOST_QUERIES)
    if blocks <= 1:
        return run(queries)
    marked, out = queries.withColumn("_block", F.pmod(F.xxhash64(by), F.lit(blocks))), None
    for k in range(blocks):
        part = run(marked.filter(F.col("_block") == k).drop("_block"))
        out = part if out is None else out.unionByName(part)
    return out


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "doc_id", vector_col: str = "embedding", dim: int | None = None, **sizes: int) -> DataFrame:
    """queries(query_id, query_vector) against all ``vectors`` (already scoped): query_id, id, score, rank. The vectors
    are read once for any number of queries; see ``knn.nearest``, also for ``sizes``."""
    if dim:
        vectors = vectors.filter(V.valid(F.col(vector_col), dim))
    return ranked(nearest(vectors, queries, top_k_of(k), metric, id_col, vector_col, **sizes), top_k_of(k), tie=id_col)


def fused(lists: list[DataFrame], weights: list[float] | None = None, k: int = MOST_TOP_K, rrf_k: int = RRF_K, digits: int = 12) -> DataFrame:
    """Weighted reciprocal-rank fusion of lists (query_id, doc_id, rank): the sum of weight / (rrf_k + rank).
    Negative weights count as 0, those that aren't finite as 1; a wrong number of weights as all 1."""
    if not weights or len(weights) != len(lists):
        weights = [1.0] * len(lists)
    weights = [1.0 if not math.isfinite(w) else max(0.0, w) for w in weights]
    parts = [x.select("query_id", "doc_id", (F.lit(w) / (rrf_k + F.col("rank"))).alias("part")) for x, w in zip(lists, weights, strict=True)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return ranked(both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), digits).alias("score")), top_k_of(k))


def hybrid(bm25: DataFrame, vector: DataFrame, alpha: float, k: int, rrf_k: int = RRF_K, digits: int = 12) -> DataFrame:
    """Fusion with weights (1 - alpha, alpha); a query that only one side has keeps that side's own scores and
    order. Each list is read once."""
    alpha = min(1.0, max(0.0, alpha))
    side = lambda x, n, w: x.select("query_id", "doc_id", "score", "rank", F.lit(n).alias("side"), (F.lit(w) / (rrf_k + F.col("rank"))).alias("part"))
    both = side(bm25, 0, 1 - alpha).unionByName(side(vector, 1, alpha))
    docs = both.groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"), F.max("score").alias("own"), F.min("rank").alias("at"), F.min("side").alias("low"), F.max("side").alias("high"))
    query = Window.partitionBy("query_id")
    mixed = F.min("low").over(query) < F.max("high").over(query)
    rows = docs.withColumn("_mixed", mixed).withColumn("score", F.when(F.col("_mixed"), F.round("part", digits)).otherwise(F.col("own")))
    order = query.orderBy(F.when(F.col("_mixed"), 0).otherwise(F.col("at")), F.col("score").desc(), F.col("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k_of(k)).select("query_id", "doc_id", "score", "rank")


def _overlap(a, b):
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def heuristic_rerank(hits: DataFrame, k: int, digits: int = 12, scope: tuple[str, str] | None = None) -> DataFrame:
    """With a ``scope`` (organisation, namespace) only that scope's hits take part. hits(query_id, query, doc_id, content, score, rank): 0.55 score in [0, 1] + 0.35 Jaccard of tokens of two
    characters or more + 0.10 if the content holds the query; ties keep the order."""
    hits = scoped(hits, *scope) if scope else hits
    q, c = (F.array_distinct(X.plain_tokens(F.col(x), 2)) for x in ("query", "content"))
    phrase = F.when(F.contains(F.lower("content"), F.lower(F.trim("query"))), 1.0).otherwise(0.0)
    score = 0.55 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))) + 0.35 * _overlap(q, c) + 0.10 * phrase
    return ranked(hits.select("query_id", "doc_id", F.round(score, digits).alias("score"), F.col("rank").alias("position")), top_k_of(k), tie="position")


def fallback_rerank(hits: DataFrame, k: int, digits: int = 12, scope: tuple[str, str] | None = None) -> DataFrame:
    """0.7 score + 0.3 Jaccard of tokens longer than one character; ties keep the order."""
    hits = scoped(hits, *scope) if scope else hits
    q, c = (F.array_distinct(F.filter(X.plain_tokens(F.col(x)), lambda t: F.length(t) > 1)) for x in ("query", "content"))
    score = 0.7 * F.col("score") + 0.3 * _overlap(q, c)
    return ranked(hits.select("query_id", "doc_id", F.round(score, digits).alias("score"), F.col("rank").alias("position")), top_k_of(k), tie="position")


def model_rerank(hits: DataFrame, predict, k: int, scope: tuple[str, str] | None = None) -> DataFrame:
    """Rerank with a model: ``predict(queries, contents)`` gets two pandas Series and returns scores."""
    import pandas as pd

    @F.pandas_udf("double")
    def udf(query: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series(predict(query, content), dtype="float64")

    hits = scoped(hits, *scope) if scope else hits
    return ranked(hits.select("query_id", "doc_id", udf("query", "content").alias("score"), F.col("rank").alias("position")), top_k_of(k), tie="position")


def boosted(hits: DataFrame, keywords: list[str], k: int) -> DataFrame:
    score = X.keyword_boost(F.col("score"), F.col("content"), X.words_array(keywords))
    return ranked(hits.withColumn("score", F.round(score, 12)).drop("rank"), top_k_of(k))


def citations(hits: DataFrame) -> DataFrame:
    """Distinct labels of each query's hits (source, page), in order of rank. Hits are at most k a query."""
    label = X.citation(F.col("source"), F.col("page"))
    return hits.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))), lambda x: x["label"])).alias("citations"))


def extractive_answer(hits: DataFrame, n: int = 3, most: int = 400) -> DataFrame:
    """The first characters of the best chunks, one after another with their citations."""
    part = F.concat(X.clean_text(F.col("content"), most), F.lit(" ["), X.citation(F.col("source"), F.col("page")), F.lit("]"))
    top = hits.filter(F.col("rank") <= n).select("query_id", "rank", part.alias("part"))
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("answer"))


def talent_ranking(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """candidates(candidate_id, resume_text, embedding) against jobs(job_id, description, embedding), in blocks of
    about 100 jobs: semantic (cos + 1) / 2, keyword the share of the job's skills, fit 0.7 and 0.3 of them; in
    percent. Candidates are ranked within their fit and keyword, of which there are some thousand values, after
    all those of better ones, so a job's candidates are ranked by many tasks."""
    own = candidates.select("candidate_id", X.skill_terms(F.col("resume_text")).alias("skills"), "embedding")
    semantic = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (V.cosine(F.col("embedding"), F.col("job_vector")) + 1) / 2))
    matched = F.array_sort(F.array_intersect("skills", "wanted"))
    keyword = F.when(F.size("wanted") > 0, F.size("matched") / F.size("wanted")).otherwise(0.0)
    percent = lambda c: F.round(c * 100, 1)

    def run(few: DataFrame) -> DataFrame:
        few = few.select("job_id", X.skill_terms(F.col("description")).alias("wanted"), F.col("embedding").alias("job_vector"))
        pairs = own.join(F.broadcast(few), F.lit(True)).withColumn("matched", matched)
        scored = pairs.select("job_id", "candidate_id", semantic.alias("s"), keyword.alias("k"), F.array_join("matched", ", ").alias("matched_skills"))
        return scored.select("job_id", "candidate_id", percent(F.col("s")).alias("semantic"), percent(F.col("k")).alias("keyword"), percent(0.7 * F.col("s") + 0.3 * F.col("k")).alias("fit"), "matched_skills")

    rows = in_blocks(jobs, "job_id", run)
    level = ["job_id", "fit", "keyword"]
    better = Window.partitionBy("job_id").orderBy(F.col("fit").desc(), F.col("keyword").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*level).agg(F.count("*").alias("n")).select(*level, F.coalesce(F.sum("n").over(better), F.lit(0)).alias("before"))
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*level).orderBy("candidate_id"))).join(before, level)
    return placed.select("job_id", "candidate_id", "semantic", "keyword", "fit", "matched_skills", (F.col("before") + F.col("nth")).cast("int").alias("rank"))


def at_least(hits: DataFrame, threshold: float, k: int | None = None, by: str | None = None, tie: str = "doc_id") -> DataFrame:
    """Hits with a score of ``threshold`` or more, best first; the best ``k`` of all or, with ``by``, of each query."""
    good = hits.filter(F.col("score") >= threshold)
    if by:
        return ranked(good.drop("rank"), k, by=by, tie=tie) if k else good
    good = good.orderBy(F.col("score").desc(), tie)
    return good.limit(k) if k else good
