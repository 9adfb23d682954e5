import math
from collections import Counter

import pytest

from loomwright.functions import text as X
from loomwright.operators import relational as R
from loomwright.operators import retrieval as T
from pyspark.sql import functions as F

CHUNKS = [
    ("leave-days", "Employees receive twenty days of annual leave each year.", "org_alpha", "policy", 0),
    ("leave-request", "Submit a leave request to your manager two weeks before.", "org_alpha", "policy", 1),
    ("benefits", "Health insurance benefits start on the first day.", "org_alpha", "policy", 2),
    ("talent-secret", "Candidate resume with python skills and leave dates.", "org_alpha", "talent", 3),
    ("other", "Leave policy of another tenant.", "org_beta", "policy", 4),
    ("nowhere", "Leave without a scope.", None, None, 5),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(*c[:4], [1.0 if k == c[4] % 8 else 0.0 for k in range(8)]) for c in CHUNKS]
    return spark.createDataFrame(rows, "doc_id string, text string, organization_id string, namespace string, embedding array<float>")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_scope_isolates_and_fails_closed(spark, chunks):
    own = R.scoped(chunks, "org_alpha", "policy")
    assert {r.doc_id for r in own.collect()} == {"leave-days", "leave-request", "benefits"}
    q = spark.createDataFrame([(0, [0.0, 1.0] + [0.0] * 6)], "query_id int, query_vector array<float>")
    hits = T.knn(own, q, 3).orderBy("rank").collect()
    assert hits[0].doc_id == "leave-request" and hits[0].score == 1.0 and [h.score for h in hits[1:]] == [pytest.approx(1 / 3)] * 2
    more = own.unionByName(chunks.filter("organization_id = 'org_beta'"))
    assert T.knn(R.scoped(more, "org_alpha", "policy"), q, 3).collect() == T.knn(own, q, 3).collect(), "another tenant's rows change nothing"


def test_knn_bounds(spark, chunks):
    q = spark.createDataFrame([(0, [1.0] + [0.0] * 7)], "query_id int, query_vector array<float>")
    for k in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            T.knn(chunks, q, k)
    assert T.top_k_of(5000) == 100
    odd = chunks.limit(1).withColumn("embedding", F.array(F.lit(float("nan")).cast("float")))
    assert T.knn(odd, q, 3, dim=8).count() == 0 == T.knn(chunks.limit(0), q, 3).count()


def test_bm25_by_hand(spark, chunks):
    own = R.scoped(chunks, "org_alpha", "policy")
    tokens = {c[0]: [w.strip(".").lower() for w in c[1].split()] for c in CHUNKS[:3]}
    n, avg = 3, sum(map(len, tokens.values())) / 3
    df = Counter(t for ts in tokens.values() for t in set(ts))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}

    def score(doc, q):
        ts = tokens[doc]
        return sum(idf[t] * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in q if t in ts)

    got = {r.doc_id: r.score for r in T.BM25Index(own).scores(queries(spark, "leave leave days unknown")).collect()}
    assert got.keys() == {"leave-days", "leave-request"}
    for d, s in got.items():
        assert s == pytest.approx(score(d, ["leave", "leave", "days"]))
    assert T.BM25Index(own).search(queries(spark, "zzz"), 3).count() == 0
    assert T.BM25Index(own.limit(0)).search(queries(spark, "leave"), 3).count() == 0


def test_tokens(spark):
    row = spark.createDataFrame([("Café e-mail -x- a1 über_b sick-leave-",)], "t string").select(X.bm25_tokens(F.col("t")).alias("b"), X.plain_tokens(F.col("t"), 2).alias("p")).first()
    assert row.b == ["e-mail", "x", "a1", "sick-leave"] and row.p == ["café", "mail", "a1", "über_b", "sick", "leave"]


def ranking(spark, *docs):
    return spark.createDataFrame([(0, d, 1.0 / (k + 1), k + 1) for k, d in enumerate(docs)], "query_id int, doc_id string, score double, rank int")


def test_fusion(spark):
    a, b = ranking(spark, "x", "y"), ranking(spark, "y", "z")
    got = {r.doc_id: r.score for r in T.fused([a, b], [0.3, 0.7]).collect()}
    assert got == {"x": pytest.approx(0.3 / 61), "y": pytest.approx(0.3 / 62 + 0.7 / 61), "z": pytest.approx(0.7 / 62)}
    assert T.fused([a, b], [1.0]).filter("doc_id = 'x'").first().score == pytest.approx(1 / 61), "a wrong number of weights counts as ones"
    odd = {r.doc_id: r.score for r in T.fused([a, b], [-1.0, float("nan")]).collect()}
    assert odd["x"] == 0 and odd["z"] == pytest.approx(1 / 62)
    listed = T.hybrid(a, b, 0.0, 10).orderBy("rank").collect()
    assert [r.doc_id for r in listed] == ["x", "y", "z"] and listed[2].score == 0, "alpha 0 still lists the other side's hits"
    alone = T.hybrid(a, b.limit(0), 0.5, 10).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in alone] == [("x", 1.0), ("y", 0.5)]


def test_rerankers(spark):
    hits = spark.createDataFrame([(0, "sick leave", "a", "About travel", 3.0, 1), (0, "sick leave", "b", "The sick leave policy", 0.5, 2), (0, "sick leave", "c", "Nothing", 0.0, 3), (0, "sick leave", "d", "Nothing", 0.0, 4)], "query_id int, query string, doc_id string, content string, score double, rank int")
    got = T.heuristic_rerank(hits, 4).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [("a", pytest.approx(0.55)), ("b", pytest.approx(0.55 * 0.5 + 0.35 * 0.5 + 0.1)), ("c", 0.0), ("d", 0.0)]
    assert [r.doc_id for r in T.fallback_rerank(hits, 2).orderBy("rank").collect()] == ["a", "b"]
    assert T.model_rerank(hits, lambda q, c: c.str.len(), 1).first().doc_id == "b"
    boosted = T.boosted(hits, ["sick", "policy"], 4).filter("doc_id = 'b'").first()
    assert boosted.score == pytest.approx(0.7)


def test_talent_ranking(spark):
    people = spark.createDataFrame([(1, "Python and SQL", [1.0, 0.0]), (2, "javascript", [0.0, 1.0]), (3, "", [0.0, 0.0])], "candidate_id int, resume_text string, embedding array<float>")
    jobs = spark.createDataFrame([(7, "Needs Python, SQL, Java", [1.0, 0.0]), (8, "anything", [1.0, 0.0])], "job_id int, description string, embedding array<float>")
    got = {(r.job_id, r.candidate_id): (r.semantic, r.keyword, r.fit, r.matched_skills, r["rank"]) for r in T.talent_ranking(people, jobs).collect()}
    assert got[7, 1] == (100.0, 66.7, 90.0, "python, sql", 1) and got[7, 2][:2] == (50.0, 33.3) and got[8, 1][1] == 0.0
