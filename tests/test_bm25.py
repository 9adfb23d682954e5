import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators.bm25 import BM25Index, StoredIndex, counted


def corpus(seed, n, first=0):
    """Words by Zipf's law, so some are in nearly all texts, with empty and null texts and very long ones."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    rows = [(first + k, " ".join(r.choices(words, weights, k=r.choice([3, 20, 60])))) for k in range(n)]
    return rows + [(first + n, ""), (first + n + 1, None), (first + n + 2, "w0 " * 3000 + "w399"), (first + n + 3, "w7 w7 w7")]


def questions(seed, n):
    r = random.Random(seed)
    return [(k, " ".join(r.choices([f"w{x}" for x in range(400)], [1 / (x + 1) for x in range(400)], k=r.choice([1, 4, 25])))) for k in range(n)] + [(n, "zzz"), (n + 1, ""), (n + 2, "w0 w0 w1"), (n + 3, "w399 zzz")]


def plain(index, queries, k):
    """The same by all scores, without pruning."""
    best = {}
    for r in index.scores(queries).collect():
        best.setdefault(r.query_id, []).append((-round(r.score, 6), r.doc_id))
    return sorted((q, d, -s, n + 1) for q, rows in best.items() for n, (s, d) in enumerate(sorted(rows)[:k]))


def found(index, queries, k, **by):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in index.search(queries, k, digits=6, **by).collect())


@pytest.mark.parametrize("k", [1, 10])
def test_pruned_search_is_exact(spark, k):
    docs, queries = spark.createDataFrame(corpus(1, 300), "doc_id long, text string"), spark.createDataFrame(questions(2, 30), "query_id long, query string")
    index = BM25Index(docs)
    got = found(index, queries, k)
    assert got == plain(index, queries, k) and {q for q, *_ in got} >= set(range(30))


def test_stored_index_after_two_appends(spark, tmp_path):
    parts = [corpus(s, n, first) for s, n, first in ((1, 200, 0), (2, 150, 1000), (3, 90, 2000))]
    queries, path = spark.createDataFrame(questions(5, 25), "query_id long, query string"), str(tmp_path / "index")
    whole = BM25Index(spark.createDataFrame(sum(parts, []), "doc_id long, text string"))
    with pytest.raises(FileNotFoundError):
        StoredIndex(spark, path)
    for rows in parts:
        before = StoredIndex.append(spark.createDataFrame(rows, "doc_id long, text string"), path)
    index = StoredIndex(spark, path)
    assert index.state == before.state and len(index.state["segments"]) == 3 and index.n == whole.n and index.avgdl == whole.avgdl
    assert sorted(map(tuple, index.term_stats.select("term", "df").collect())) == sorted(map(tuple, whole.term_stats.select("term", "df").collect()))
    want = found(whole, queries, 7)
    assert found(index, queries, 7, by="lists") == found(index, queries, 7, by="rows") == want == plain(whole, queries, 7)
    again = StoredIndex.append(spark.createDataFrame(parts[0], "doc_id long, text string"), path)
    assert again.n == index.n and found(again, queries, 7) == want, "ids that are there already are skipped"
    merged = StoredIndex.append(spark.createDataFrame([(5000, "w0 w1")], "doc_id long, text string"), path, most_segments=1)
    assert len(merged.state["segments"]) == 1 and merged.n == index.n + 1
    grown = BM25Index(spark.createDataFrame([*sum(parts, []), (5000, "w0 w1")], "doc_id long, text string"))
    assert found(merged, queries, 7, by="lists") == found(merged, queries, 7) == found(grown, queries, 7)
    assert merged.blocks.agg(F.max("n")).first()[0] <= 128
    assert merged.blocks.filter("size(ids) != n or array_max(tfs) != max_tf or array_min(dls) != min_dl").isEmpty()


def test_blocks_that_cannot_help_go_unread(spark, tmp_path):
    """A rare word's few texts are results for sure, so of the frequent word's blocks only those with short texts count."""
    rows = [(k, "often " + "filler " * (5 if k < 128 else 400)) for k in range(1280)] + [(5000 + k, "rare rare rare often") for k in range(5)]
    index = StoredIndex.append(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "index"))
    queries = spark.createDataFrame([(0, "rare often")], "query_id long, query string")
    assert [r.doc_id for r in index.search(queries, 5).orderBy("rank").collect()] == [5000, 5001, 5002, 5003, 5004]
    asked = index._asked(queries).withColumn("needs", F.lit(0.5 * index.term_stats.filter("term = 'often'").first().idf))
    assert index._postings_of(asked.filter("term = 'often'")).count() < 1280


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = counted(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_negative_mean_idf(spark):
    """All words in all texts: every weight is a quarter of a negative mean, and the search is exact all the same."""
    docs = spark.createDataFrame([(k, "a b " + "a " * k) for k in range(6)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "a b"), (1, "b")], "query_id long, query string")
    index = BM25Index(docs)
    assert found(index, queries, 3) == plain(index, queries, 3) and all(s < 0 for _, _, s, _ in found(index, queries, 3))
