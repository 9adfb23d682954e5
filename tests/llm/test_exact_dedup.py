import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomwright.llm.exact_dedup import Directory, build_index, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


ROWS = [(None, None), (3, ""), (4, ""), (5, "x"), (5, "x"), (None, "y"), (None, "y"), (1, "z" * 100_000), (2, "z" * 100_000), (9, "é"), (8, "é")] + [(k, f"t{k % 37}") for k in range(100, 400)] + [(k, "hot") for k in range(1000, 1500)]


@pytest.mark.parametrize("key,capacity,owners", [(None, None, None), (lambda t: F.length(t).cast("long"), 2, 3), (lambda t: F.xxhash64(t), 5, 4), (lambda t: F.lit(7).cast("long"), 1, 2)])
def test_groups(spark, key, capacity, owners):
    docs = spark.createDataFrame([(*r, 1, "b") for r in ROWS], "doc_id long, text string, key int, ids string").repartition(3)
    index = build_index(docs, capacity=capacity, owners=owners, key=key)
    got = index.groups().collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(ROWS)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in ROWS})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert index.entries.count() == len(kept)


def test_probe_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    index = build_index(docs)
    other = spark.createDataFrame([(1, "hot"), (2, "cold"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in index.probe(other).collect()} == {1: (1499, 500), 2: (None, None), 3: (4, 3)}
    assert exact_dedup(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bits,n,capacity,step", [(64, 3000, 16, 6), (64, 3000, 16, 14), (5, 32, 3, 4)])
def test_directory(bits, n, capacity, step):
    r = random.Random(1)
    keys = {r.getrandbits(bits) for _ in range(n)}

    def count(depth, within):
        return Counter(k >> (64 - depth) for k in keys if not within or k >> (64 - within[0]) in set(within[1]))

    d = Directory(count, capacity, step)
    lows = d.lows()
    assert lows[0] == 0 and lows == sorted(set(lows))
    assert sum(2 ** (64 - b[0]) for b in d.buckets) == 2**64, "the buckets cover all keys, none twice"
    for (depth, prefix, found), low in zip(d.buckets, lows, strict=True):
        own = sum(low <= k < low + 2 ** (64 - depth) for k in keys)
        assert own == found <= capacity
        assert not depth or sum(k >> (65 - depth) == prefix >> 1 for k in keys) > capacity, "only overfull buckets are split"
    assert max(d.owners(5)) <= 4 and d.owners(5) == sorted(d.owners(5))


@pytest.mark.parametrize("key,owners", [(None, 4), (lambda t: F.lit(7).cast("long"), 3), (lambda t: F.xxhash64(F.substring(t, 1, 1)), 1)])
@pytest.mark.parametrize("hot", [0, 400])
def test_a_text_in_every_task(spark, key, owners, hot):
    """Hot keys meet at sub-owners first: one text in all of 9 tasks, several texts under one key, null ids, repeats."""
    rows = [*ROWS, *[(2000 + k, "everywhere " * 9) for k in range(90)], *[(None, "nowhere " * 9)] * 40, *[(3000, "twice")] * 30]
    random.Random(owners).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    index = build_index(docs, owners=owners, key=key, hot_bytes=hot)
    got = index.groups().collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    assert set(Counter(r.text_sha256 for r in got if r.kept).values()) == {1}
    assert index.entries.count() == len({t or "" for _, t in rows})


def test_owners_of_hot_texts_get_them_once_a_sub_owner(spark):
    docs = spark.createDataFrame([(k, "hot text") for k in range(400)], "doc_id long, text string").repartition(40)
    apart, plain = (build_index(docs, owners=4, hot_bytes=h).rows for h in (10, 1 << 30))
    assert apart.filter("kind = 0").count() == plain.filter("kind = 0").count() == 40
    sent = [r.asDict() for r in apart.filter("kind = 1").collect()]
    assert len(sent) == 1 and (sent[0]["best"], sent[0]["total"]) == (399, 400)
