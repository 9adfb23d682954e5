import math
import random

import pytest

from loomwright.operators.metrics import health, metric_stats
from loomwright.operators.quantiles import percentiles


def plain(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    low, part = math.floor(at), at - math.floor(at)
    return values[low] if part == 0 else values[low] + (values[low + 1] - values[low]) * part


SHARES = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("accuracy,small", [(10_000, 100_000), (20, 30), (100, 0)])
def test_groups(spark, accuracy, small):
    """Ties, one value, spreads of 600 decades, nulls; also where sketches are coarse, so that spans are narrow or wrong."""
    r = random.Random(accuracy)
    groups = {"one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 500, "ties": [float(r.randrange(3)) for _ in range(700)], "wide": [10.0 ** r.randrange(-300, 300) * r.choice([-1, 1]) for _ in range(900)], "plain": [r.random() for _ in range(1500)], "mostly": [0.0] * 990 + [float(k) for k in range(10)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("plain", None), ("empty", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, value double").repartition(5)
    got = {x.name: x for x in percentiles(df, ["name"], "value", SHARES, accuracy, small).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g].n == len(values)
        assert [got[g][f"p_{k}"] for k in range(len(SHARES))] == [plain(values, s) for s in SHARES]
    alone = percentiles(df, [], "value", [0.5], accuracy, small).collect()
    assert [(x.n, x.p_0) for x in alone] == [(sum(map(len, groups.values())), plain(sum(groups.values(), []), 0.5))]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "name string, seq long, value double")
    assert percentiles(empty, ["name"], "value", [0.5]).collect() == [] == metric_stats(empty).collect()
    row = health(spark.createDataFrame([], "latency double, cost double, cache_hit boolean, error boolean")).first()
    assert row.requests == 0 and row.p95_latency is None


def test_null_names_are_a_group(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), ("", 3, 9.0), ("none", 4, None)], "name string, seq long, value double")
    got = {x.name: (x.n, x.p50) for x in metric_stats(df).collect()}
    assert got == {None: (2, 3.0), "": (1, 9.0), "none": (0, None)}


def test_no_state_grows_with_values(spark):
    df = spark.range(1000).selectExpr("id % 3 AS name", "cast(id AS double) AS value", "id AS seq")
    plan = metric_stats(df)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
