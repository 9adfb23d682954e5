import datetime
import glob
import os
import re

import numpy as np
import pandas as pd
import pytest

from loomwright.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(map(plain, v))
    if isinstance(v, float | np.floating):
        return None if v != v else round(float(v), 6)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, pd.Timestamp | datetime.date):
        return str(pd.Timestamp(v))
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries without SQL, each with a test of its values below.
WITHOUT_SQL = {"g5_pii_types", "g8_guard", "a15_guard_counters", "t6_ingest", "v14_answers"}


def test_all_others_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == WITHOUT_SQL


def _texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_g5_pii_types(spark):
    from loomwright.functions import guards as G

    found = {d: [k for k, p in G.PII.items() if re.search(p, t, re.A)] for d, t in _texts(spark).items()}
    got = {r.doc_id: r.pii for r in catalog.QUERIES["g5_pii_types"](spark, SF).collect()}
    assert got == {d: kinds for d, kinds in found.items() if kinds} and len(got) > 5


def test_g8_guard(spark):
    from loomwright.functions import guards as G

    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = catalog.QUERIES["g8_guard"](spark, SF).collect()
    assert len(rows) == len(texts) * len(catalog._PROBES) and {(r.item_id, r.probe) for r in rows} == {(i, p) for i in texts for p in catalog._PROBES}
    for r in rows:
        text = f"{r.probe} {texts[r.item_id]}" if r.item_id % 2 == 0 else texts[r.item_id]
        threat = next((kind for kind, patterns in G.THREATS if any(re.search(p, text, re.I) for p in patterns)), None)
        if len(text) > G.MOST_LENGTH:
            assert r.reason == "too_long"
        elif threat:
            assert r.reason == threat
        assert r.safe == (r.reason is None) and (r.sanitized is not None) == r.safe
        if r.safe:
            assert not re.search(r"[<>{}`]|\s\s", r.sanitized) and not any(re.search(p, r.sanitized, re.A) for p in G.PII.values())
    assert {r.reason for r in rows} >= {None, "prompt_injection", "jailbreak", "sql_injection", "os_command", "code_injection"}


def test_a15_guard_counters(spark):
    from loomwright.functions import guards as G

    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    row = catalog.QUERIES["a15_guard_counters"](spark, SF).first()
    long = [t for t in texts if len(t) > G.MOST_LENGTH or len(t.strip(" ")) < G.LEAST_LENGTH]
    threats = [t for t in texts if t not in long and any(re.search(p, t, re.I) for _, patterns in G.THREATS for p in patterns)]
    assert (row.total, row.length_violations, row.injections, row.rate_limited) == (len(texts), len(long), len(threats), 0)
    assert row.pii_detected == sum(any(re.search(p, t, re.A) for p in G.PII.values()) for t in texts)
    assert len(long) + len(threats) <= row.blocked <= row.total


def test_t6_ingest(spark):
    import hashlib

    from loomwright.operators.chunks import spans

    rows = {}
    for d, text in _texts(spark).items():
        for k, content, a, b in spans(text):
            rows[hashlib.sha256("\u001f".join(["org", "policy", str(d), str(k), content]).encode()).hexdigest()[:32]] = (str(d), k, content, a, b)
    got = {r.chunk_id: (r.source, r.chunk_index, r.content, r.char_start, r.char_end) for r in catalog.QUERIES["t6_ingest"](spark, SF).collect()}
    assert got == {c: r for c, r in rows.items() if not r[0].startswith("1")}


def test_v14_answers(spark):
    """Every answer is made of the beginnings of texts of the scope, with their labels; the others say why not."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").filter("source = 'src0' and lang = 'en'").collect()}
    asked = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = catalog.QUERIES["v14_answers"](spark, SF).collect()
    assert {r.query_id for r in rows} == asked and any(r.answer for r in rows)
    for r in rows:
        assert (r.answer is None) or r.reason is None
        parts = re.findall(r"(.*?) \[src0 \(Page (\d)\)\](?:\n\n|\Z)", r.answer or "", re.S)
        assert r.answer is None or 1 <= len(parts) <= 3
        for content, page in parts:
            start = content.rstrip("…")[:40].split("[")[0]
            assert any(d % 9 == int(page) and start.strip() in (x.text or "") for d, x in docs.items())
