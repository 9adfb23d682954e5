"""Whole flows: ingestion of documents, and questions to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import text as X
from ..operators import chunks as K
from ..operators import retrieval as T
from ..operators.guard import guarded
from ..operators.models import embedded
from ..operators.relational import new_chunks, scoped


def ingested(documents: DataFrame, store: DataFrame | None, organization: str, namespace: str, encode=None, dim: int | None = None) -> DataFrame:
    """documents(source, text): the chunks that the store doesn't have yet, stamped with their scope and ids."""
    rows = K.chunked(documents.select("source", F.col("text")), id_col="source")
    chunk_id = F.substring(F.sha2(F.concat_ws("\u001f", F.lit(organization), F.lit(namespace), "source", F.col("chunk_index").cast("string"), "content"), 256), 1, 32)
    rows = rows.select(chunk_id.alias("chunk_id"), F.lit(organization).alias("organization_id"), F.lit(namespace).alias("namespace"), "source", "chunk_index", "content", "char_start", "char_end")
    rows = rows.dropDuplicates(["chunk_id"])
    if store is not None:
        rows = new_chunks(rows, store)
    return embedded(rows, encode, "content", dim=dim) if encode else rows


def retrieved(chunks: DataFrame, queries: DataFrame, organization: str, namespace: str, k: int = 5, alpha: float = 0.7, index: T.BM25Index | None = None) -> DataFrame:
    """Hybrid retrieval and reranking within a scope. chunks(chunk_id, content, source, page, embedding),
    queries(query_id, query, query_vector): query_id, doc_id, score, rank. Each list gives three candidates a
    result (100 at most). The scope comes first, so it can't leave a query short of hits, and BM25's statistics
    are those of the scope; the reranker checks it again. ``index``: the scope's own, as ``sinks.scope_index`` keeps it."""
    own = scoped(chunks, organization, namespace).select(F.col("chunk_id").alias("doc_id"), "content", "source", "page", "embedding", "organization_id", "namespace")
    pool = T.pool_of(k)
    bm25 = (index or T.BM25Index(own, text_col="content")).search(queries, pool)
    vector = T.knn(own, queries.select("query_id", "query_vector"), pool)
    hits = T.hybrid(bm25, vector, alpha, pool)
    texts = own.select("doc_id", "content", "source", "page", "organization_id", "namespace")
    ranked = T.heuristic_rerank(hits.join(texts, "doc_id").join(queries.select("query_id", "query"), "query_id"), k, scope=(organization, namespace))
    return ranked.join(texts.drop("organization_id", "namespace"), "doc_id")


def answered(queries: DataFrame, chunks: DataFrame, organization: str, namespace: str, role_col: str | None = None) -> DataFrame:
    """query_id, route, answer or reason: guard, route, retrieve, answer from the best chunks, redact."""
    checked = guarded(queries, role_col=role_col)
    asked = checked.filter("safe").withColumn("query", F.col("sanitized"))
    answers = T.extractive_answer(retrieved(chunks, asked, organization, namespace))
    answers = answers.withColumn("answer", G.redact_pii(F.col("answer")))
    routed = checked.select("query_id", "reason", X.ui_route(F.col("query")).alias("route"))
    return routed.join(answers, "query_id", "left")
