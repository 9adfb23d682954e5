import math
import random

import pytest

from loomwright.llm.topk import top_k


def brute(rows, k=5, every=50):
    v = [(i, [math.floor(256 * c) for c in x]) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for n, (q, own) in enumerate(v):
        if q is not None and q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(own, x)), i is None, i or 0) for m, (i, x) in enumerate(v) if m != n)[:k]
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("pivots,group,block", [(None, 4096, 32768), (5, 3, 40), (1, 1, 7), (64, 4, 16)])
def test_same_as_brute_force(spark, pivots, group, block):
    r = random.Random(block)
    rows = [(k, [r.uniform(-1, 1) for _ in range(6)]) for k in range(300)]
    rows += [(k, [5 + r.uniform(0, 0.1)] * 6) for k in range(300, 420)] + [(k, [0.25] * 6) for k in range(420, 600)]
    rows += [(None, [1.0] * 6), (700, None), (701, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (750, [float("nan")] * 6), (702, [float("inf")] * 6), (800, [0.5, 0.5]), (801, []), (850, [0.0] * 6), (-50, [1.0] * 6), (-50, [1.0] * 6), (50, [0.5] * 6), (3, [0.7] * 6)]
    df = spark.createDataFrame([(i, x, "z") for i, x in rows], "vec_id long, embedding array<double>, block string").repartition(3)
    got = sorted(map(tuple, top_k(df, pivots=pivots, group_queries=group, block_rows=block).collect()), key=repr)
    assert got == brute(rows)


def test_large_components_few_rows_and_repeats(spark):
    rows = [(0, [9e6, -3e6]), (50, [3e5, 1.5]), (3, [7e5, 9e5]), (0, [9e6, -3e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df).collect()), key=repr) == brute(rows)
    assert top_k(df.limit(0)).collect() == []
    assert top_k(df.filter("vec_id = 3")).collect() == []
    assert top_k(df.filter("vec_id = 50")).collect() == []


@pytest.mark.parametrize("parts", [1, 3])
def test_ids_of_all_64_bits_beside_nulls(spark, parts):
    rows = [(None, [1.0, 2.0]), (1152921504606846950, [0.5, 0.25]), (1152921504606847000, [3.0, 1.0]), (1152921504606846951, [2.0, 2.0]), (-9223372036854775800, [0.1, 0.1]), (2**63 - 1, [0.2, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).repartition(parts)
    want = brute(rows)
    assert {q for q, *_ in want} == {1152921504606846950, 1152921504606847000, -9223372036854775800}
    assert sorted(map(tuple, top_k(df).collect()), key=repr) == want
    assert sorted(map(tuple, top_k(df.filter("vec_id is not null")).collect()), key=repr) == brute(rows[1:])


def test_distant_groups_get_only_what_they_need():
    import numpy as np

    from loomwright.llm.topk import Plan

    frame = np.array([[0.0, 0.0], [1000.0, 0.0]]), np.zeros(2)
    near = {0: [0, 1, 1, 2, 2, 3], 1: [0, 1, 1, 2, 2, 3]}
    plan = Plan(frame, 0.0, 2, {0: (9, 3.0), 1: (9, 3.0)}, near, {0: (4, 1.0), 1: (4, 1.0)}, 5, 4, 4)
    assert plan.groups == [([0], 1), ([1], 1)] and plan.blocks == [([0], 3), ([1], 3)]
    assert plan.meets == [[0], [1]], "neither group gets the other's vectors, nor its queries go there"
    assert plan.reach == {0: 5.0, 1: 5.0}
    assert {b for _, _, _, b, _ in plan.of_queries([0] * 4, range(4))} == {0}


def test_clustered_vectors_are_pruned(spark):
    r = random.Random(2)
    rows = [(k, [(20.0 if k % 4 == c else 0.0) + r.uniform(0, 0.2) for c in range(4)]) for k in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, top_k(df, group_queries=20, block_rows=100).collect()), key=repr) == brute(rows)
