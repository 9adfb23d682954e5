"""What tasks hold and shuffle doesn't grow with batches, or with the square of a table."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import types as T

from loomwright.operators import bm25, chunks, knn


class Caught:
    """In place of a DataFrame: keeps the function that runs over its Arrow batches."""

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "doc_id")])

    def select(self, *columns):
        return self

    withColumnRenamed = select

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def peak(run, batch) -> tuple[int, int]:
    """Rows given back, and MB of Python objects at most."""
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return rows, most


def test_chunks_of_a_large_batch(spark):
    """F8, F9."""
    batch = pa.RecordBatch.from_pydict({"id": list(range(4000)), "text": ["word and. more " * 100] * 4000})
    rows, most = peak(chunks.chunked(Caught()).run, batch)
    assert rows >= 4000 * 5 and most < 8


def test_counts_of_a_large_batch(spark):
    """F3, F5, F6, F7."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "tokens": [[f"t{k % 997}" for k in range(n, n + 300)] for n in range(3000)]})
    rows, most = peak(bm25.counted(Caught()).run, batch)
    assert rows == 3000 and most < 25


def test_shuffle_of_all_vectors_grows_with_them(spark):
    """F4."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    size = []
    for n in (400, 1600):
        vectors = spark.range(n).selectExpr("id", "transform(sequence(1, 16), x -> rand(7) + x * 0) AS v")
        before = written()
        assert knn.nearest(vectors, vectors.selectExpr("id AS query_id", "v AS query_vector"), 2, "l2", "id", "v", few_queries=0, group_queries=16, block_rows=16).count() >= 2 * n
        size.append(written() - before)
    assert size[1] < 6 * size[0], size
