"""The engine's relational tables as views of the test tables: SQL that Spark and DuckDB both read."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime.datetime(2024, 2, 1)
ORDERS_AS_OF = datetime.datetime(1998, 9, 1)

VIEWS = {
    "users": """SELECT c_custkey AS id, c_name AS username, 'hash' AS password_hash, 'org_' || CAST(c_nationkey % 5 AS STRING) AS organization_id,
        CASE WHEN c_custkey % 10 = 0 THEN 'admin' WHEN c_custkey % 10 < 4 THEN 'editor' ELSE 'viewer' END AS role,
        CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS is_active FROM customer""",
    "requests": """SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'editor' ELSE 'viewer' END AS from_role, 'admin' AS to_role,
        CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status, o_orderdate AS created_at FROM orders""",
    "audit": """SELECT event_id AS id, 'user' || CAST(user_id AS STRING) AS username, 'org_' || CAST(user_id % 5 AS STRING) AS organization_id,
        event_type AS action, ts AS timestamp, value AS latency, value / 1000 AS cost, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS blocked FROM events""",
    "files": """SELECT doc_id AS id, source || '/' || CAST(doc_id AS STRING) || '.txt' AS filename, source AS organization_id, CAST((n_chars + 299 - (n_chars + 299) % 300) / 300 AS BIGINT) AS chunk_count, n_chars AS file_size,
        CASE WHEN doc_id % 17 = 0 THEN 'deleted' WHEN doc_id % 19 = 0 THEN NULL ELSE 'active' END AS status, doc_id % 2 AS ocr_used, doc_id * 7 % 1000 AS uploaded_at FROM documents""",
    "chunks": """SELECT doc_id, 'c' || CAST(doc_id AS STRING) AS chunk_id, text AS content, source AS organization_id, lang AS namespace, source, CAST(doc_id % 9 AS INT) AS page,
        CAST(n_chars % 100 AS DOUBLE) / 100 AS score FROM documents""",
    "candidates": """SELECT doc_id AS id, source AS organization_id, 'user' || CAST(doc_id % 7 AS STRING) AS uploaded_by, CASE WHEN doc_id % 3 = 0 THEN 'placed' ELSE 'bench' END AS status, n_chars FROM documents""",
    "jobs": """SELECT p_partkey AS id, p_name AS title, p_type AS description, p_brand AS skills, p_brand AS department, p_type AS location, CASE WHEN p_size > 25 THEN 'full-time' ELSE 'contract' END AS kind,
        p_size AS experience, p_partkey % 2 = 0 AS remote FROM part""",
    "messages": """SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, role, text AS content, conv_id, turn, text, 'u' || CAST(conv_id % 11 AS STRING) AS user_id FROM conversations""",
    "sessions": """SELECT DISTINCT conv_id AS id, 'u' || CAST(conv_id % 11 AS STRING) AS username, 'org_' || CAST(conv_id % 2 AS STRING) AS organization_id FROM conversations""",
    "requests_log": """SELECT event_id AS id, user_id, value AS latency, value / 1000 AS cost, event_type = 'view' AS cache_hit, event_type = 'error' AS error, ts FROM events""",
    "metrics": """SELECT event_type AS name, event_id AS seq, value FROM events""",
    "cache": """SELECT 'org' AS organization_id, 'policy' AS namespace, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'u1' END AS user_id, CASE WHEN item_id % 2 = 0 THEN NULL ELSE 'viewer' END AS role,
        text AS query_text, 'answer ' || CAST(item_id AS STRING) AS answer, item_id AS hits, item_id * 60 AS age FROM benchmark""",
}
TABLES = {"users": "customer", "requests": "orders", "audit": "events", "files": "documents", "chunks": "documents", "candidates": "documents", "jobs": "part", "messages": "conversations", "sessions": "conversations", "requests_log": "events", "metrics": "events", "cache": "benchmark"}


class Tables:
    """The test tables and the views of them as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            base = TABLES[name]
            return self.spark.sql(VIEWS[name].replace(f"FROM {base}", "FROM {t}"), t=getattr(self, base))
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views in front."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"
