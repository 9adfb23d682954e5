"""The guard pipeline over queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import guards as G
from ..streaming.rate_limit import Limits, limited


@F.pandas_udf(T.StringType())
def normalised(text: pd.Series) -> pd.Series:
    """NFKC, then without format characters (Spark has no function for the former)."""
    import unicodedata

    def one(t):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf")

    return text.map(one)


def guarded(queries: DataFrame, text_col: str = "query", role_col: str | None = None, rate_ok: Column | None = None, nfkc: bool = True, rate: Limits | None = None) -> DataFrame:
    """queries with safe, reason (null if safe), pii (kinds found) and sanitized.

    In order: length, rate, threats, sensitive topics (for viewers); then personal data
    is redacted and the text sanitised. Null texts are too short; a null role is a viewer. ``rate`` limits the queries
    by their identities (ids must be distinct); those of a wrong length don't count there, those that a later check
    blocks do. ``rate_ok`` is a ready decision instead.
    """
    plain = normalised(F.col(text_col)) if nfkc else G.strip_format_characters(F.col(text_col))
    rows = queries.withColumn("_plain", plain)
    text = F.col("_plain")
    role = F.coalesce(F.lower(F.col(role_col)), F.lit("viewer")) if role_col else F.lit("viewer")
    reasons = [G.length_problem(text)]
    if rate:
        refused = limited(rows.filter(reasons[0].isNull()), rules=rate).filter(~F.col("accepted")).select(rate.event_id, F.lit(False).alias("_in_rate"))
        rows, rate_ok = rows.join(refused, rate.event_id, "left"), F.coalesce("_in_rate", F.lit(True))
    if rate_ok is not None:
        reasons.append(F.when(~rate_ok, "rate_limit"))
    reasons += [G.threat(text), F.when(G.sensitive_topic(text) & (role == "viewer"), "sensitive")]
    rows = rows.withColumn("reason", F.coalesce(*reasons)).withColumn("safe", F.col("reason").isNull())
    return rows.withColumn("pii", G.pii_types(text)).withColumn("sanitized", F.when(F.col("safe"), G.sanitise(G.redact_pii(text)))).drop("_plain", "_in_rate")
