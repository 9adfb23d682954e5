import random
import zlib
from collections import Counter, defaultdict

import pytest

from loomwright.llm.kdshards import kd_shards


def brute(texts, n):
    """(text -> shard): the same tree by sorting."""
    import hashlib

    def dims(t):
        return len(t.encode()), len(t), t.count(" "), t.count("\n")

    rows = [(t or "", len((t or "").encode()) + 1) for t in texts]
    span = [max(1, max(dims(t)[d] for t, _ in rows) - min(dims(t)[d] for t, _ in rows)) for d in range(4)]
    tie = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    shard = {}

    def split(part, k, first):
        if k == 1 or len({t for t, _ in part}) <= 1:
            shard.update({t: first for t, _ in part})
            return
        width = [(max(dims(t)[d] for t, _ in part) - min(dims(t)[d] for t, _ in part)) / span[d] for d in range(4)]
        d = width.index(max(width))
        part = sorted(part, key=lambda x: (dims(x[0])[d], tie(x[0])))
        goal, run = -(-sum(w for _, w in part) * (k // 2) // k), 0
        for t, w in part:
            run += w
            if run >= goal:
                cut = dims(t)[d], tie(t)
                break
        key = lambda x: (dims(x[0])[d], tie(x[0]))
        split([x for x in part if key(x) <= cut], k // 2, first)
        split([x for x in part if key(x) > cut], k - k // 2, first + k // 2)

    split(rows, n, 0)
    return shard


@pytest.mark.parametrize("n", [1, 3, 16])
def test_same_as_sorting(spark, n):
    r = random.Random(n)
    texts = [None, "", "a", "é 中\n"] + ["".join(r.choices("ab \né", k=r.randrange(0, 60))) for _ in range(500)] + ["hot text"] * 150
    docs = spark.createDataFrame([(None if k == 9 else k // 2, t, "x", 5) for k, t in enumerate(texts)], "doc_id long, text string, shard string, size long")
    got = kd_shards(docs, n_shards=n, slot_buckets=3).collect()
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in got) == Counter((None if k == 9 else k // 2, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for k, t in enumerate(texts))
    want = brute(texts, n)
    assert Counter((r.text_crc32, r.shard) for r in got) == Counter((zlib.crc32((t or "").encode()), want[t or ""]) for t in texts)
    slots = defaultdict(list)
    for row in got:
        slots[row.shard].append(row.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(row.law == "bytes" and row.grown_shard is None for row in got)


def test_near_equal_and_target(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 40)) for k in range(4000)], "doc_id long, text string")
    total = docs.selectExpr("sum(octet_length(text) + 1)").first()[0]
    for out in (kd_shards(docs, n_shards=16), kd_shards(docs, target_bytes=total // 16 + 1)):
        sizes = [r[0] for r in out.groupBy("shard").sum("size").select("sum(size)").collect()]
        assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.02 * total / 16
    assert kd_shards(docs.limit(0), n_shards=16).collect() == []


def test_many_shards_and_stored_levels(spark):
    """More shards than a plan could hold as an expression; a leaf for each text, if need be."""
    docs = spark.createDataFrame([(k, "x" * (k % 97) + f" {k}") for k in range(6000)] + [(None, "hot")] * 500, "doc_id long, text string")
    got = kd_shards(docs, n_shards=5000).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert len(got) == 6500 and len(shards) > 3000 and max(shards) < 5000
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
