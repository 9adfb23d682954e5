import math
import random

import pytest

from loomwright.operators import retrieval as T

SCORES = {
    "l2": lambda a, b: 1 / (1 + sum((x - y) ** 2 for x, y in zip(a, b, strict=True))),
    "ip": lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)),
    "cosine": lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / n if (n := math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))) > 1e-12 else 0.0,
}


def whole(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def brute(vectors, queries, k, metric):
    out = []
    for q, a in queries:
        if q is not None and whole(a):
            best = sorted((-SCORES[metric](a, v), i) for i, v in vectors if i is not None and whole(v) and len(v) == len(a))[:k]
            out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


def table(seed, n):
    r = random.Random(seed)
    rows = [(k, [float(r.randrange(-3, 4)) for _ in range(5)]) for k in range(n)]  # small integers: ties, exact sums
    return rows + [(9000, None), (9001, [1.0, None, 1.0, 1.0, 1.0]), (9002, [float("nan")] * 5), (9003, [float("inf")] * 5), (9004, [1.0, 2.0]), (9005, []), (9006, [0.0] * 5), (None, [1.0] * 5), (9007, [1e6, 1.0, 0.0, 0.0, -1e6])]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("sizes", [{}, {"few_queries": 0}, {"few_queries": 0, "group_queries": 7, "block_rows": 50}])
def test_brute_force(spark, metric, sizes):
    vectors, queries = table(1, 1500 if not sizes else 300), [*table(2, 25), (77, [3.0, 4.0])]
    df = spark.createDataFrame(vectors, "doc_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    got = T.knn(df, asked, 4, metric, **sizes).collect()
    want = brute(vectors, queries, 4, metric)
    if metric == "cosine":  # rounded ties fall either way
        assert [(r[0], r[3], r[2]) for r in sorted(got, key=lambda r: (r[0], r[3]))] == [(q, n, pytest.approx(s, abs=1e-9)) for q, i, s, n in sorted(want, key=lambda r: (r[0], r[3]))]
    else:
        assert sorted(map(tuple, got)) == want


def test_string_ids_floats_and_nothing(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("é", [1.0, 0.0]), ("c", [0.0, 1.0])], "doc_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<float>")
    for sizes in ({}, {"few_queries": 0}):
        assert [tuple(r) for r in T.knn(df, asked, 3, **sizes).orderBy("rank").collect()] == [("q", "a", 1.0, 1), ("q", "b", 1.0, 2), ("q", "é", 1.0, 3)]
        assert T.knn(df.limit(0), asked, 3, **sizes).collect() == [] == T.knn(df, asked.limit(0), 3, **sizes).collect()


@pytest.mark.parametrize("sizes", [{}, {"few_queries": 0, "group_queries": 10}])
def test_vectors_are_read_once(spark, tmp_path, sizes):
    spark.createDataFrame(table(1, 50), "doc_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    asked = spark.createDataFrame(table(2, 40), "query_id long, query_vector array<double>")
    plan = T.knn(spark.read.parquet(str(tmp_path / "v")), asked, 3, **sizes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
