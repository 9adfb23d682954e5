"""Exact kNN by blocks: matrix products in Arrow batches, each task with a bounded list for each query."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import TINY

FEW_QUERIES, GROUP_QUERIES, BLOCK_ROWS, SLICE = 4096, 4096, 65_536, 1024
LANE_QUERIES = 65_536  # queries of one task
METRICS = ("l2", "ip", "cosine")


def _matrix(column, dim: int | None = None):
    """Rows of an array column that are whole (no null, NaN or infinite component; of length ``dim`` if given): their
    places, grouped by length, with a float64 matrix each."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    wrong = np.r_[0, np.cumsum(~np.isfinite(values))]
    good = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[offsets[1:]] == wrong[offsets[:-1]]) & (sizes > 0)
    for d in np.unique(sizes[good]) if dim is None else [dim]:
        at = np.flatnonzero(good & (sizes == d))
        if len(at):
            yield int(d), at, values[offsets[at][:, None] + np.arange(d)]


class Best:
    """For each query (a number) its best rows so far, at most k; ties go to the smaller id."""

    def __init__(self, k: int):
        import numpy as np

        self.k, self.q, self.id, self.score = k, np.empty(0, np.int64), None, np.empty(0)

    def add(self, q, ids, score) -> None:
        import numpy as np

        if not len(q):
            return
        q, score, ids = np.r_[self.q, q], np.r_[self.score, score], ids if self.id is None else np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        keep = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)])) < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]


class _Queries:
    """Queries of one length and the best rows for each."""

    def __init__(self, ids, m, k: int, metric: str):
        import numpy as np

        self.ids, self.m, self.k, self.metric, self.best = ids, m, k, metric, Best(k)
        self.norm2 = (m * m).sum(1)
        self.least = np.full(len(ids), -np.inf)  # what a vector must come near, in the scale of _near

    def _near(self, v, v2):
        """Larger is nearer: rounded, to choose whose scores are worked out."""
        import numpy as np

        dots = self.m @ v.T
        if self.metric == "ip":
            return dots, 1e-9 * float(np.sqrt(self.norm2.max() * v2.max())) + 1e-300
        if self.metric == "cosine":
            both = np.sqrt(self.norm2)[:, None] * np.sqrt(v2)[None]
            return np.divide(dots, both, out=np.zeros_like(dots), where=both > TINY), 1e-9
        return 2 * dots - self.norm2[:, None] - v2[None], 1e-9 * float(self.norm2.max() + v2.max()) + 1e-300

    def _scores(self, qi, v, vi):
        import numpy as np

        out = np.empty(len(qi))
        for k in range(0, len(qi), 65_536):
            a, b = self.m[qi[k : k + 65_536]], v[vi[k : k + 65_536]]
            if self.metric == "l2":
                out[k : k + 65_536] = 1 / (1 + ((a - b) ** 2).sum(1))
            else:
                dots = (a * b).sum(1)
                if self.metric == "cosine":
                    both = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
                    dots = np.divide(dots, both, out=np.zeros_like(dots), where=both > TINY)
                out[k : k + 65_536] = dots
        return out

    def meet(self, ids, v) -> None:
        import numpy as np

        for s in range(0, len(v), SLICE):
            own, names = v[s : s + SLICE], ids[s : s + SLICE]
            near, slack = self._near(own, (own * own).sum(1))
            if len(own) > self.k:
                kth = np.partition(near, len(own) - self.k, axis=1)[:, len(own) - self.k]
                self.least = np.maximum(self.least, kth - 2 * slack)
            qi, vi = np.nonzero(near >= self.least[:, None])
            self.best.add(qi, names[vi], self._scores(qi, own, vi))

    def rows(self):
        return self.ids.take(pa.array(self.best.q)), self.best.id, self.best.score


def _asking(table: pa.Table, k: int, metric: str) -> dict[int, _Queries]:
    ids = table.column("query_id").combine_chunks()
    return {d: _Queries(ids.take(pa.array(at)), m, k, metric) for d, at, m in _matrix(table.column("query_vector"))}


def _met(queries: dict[int, _Queries], ids, vectors) -> None:
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    names = ids.to_numpy(zero_copy_only=False)
    for d, at, m in _matrix(vectors):
        if d in queries:
            queries[d].meet(names[at], m)


def _answers(queries: dict[int, _Queries], schema: pa.Schema):
    found = [q.rows() for q in queries.values() if len(q.best.q)]
    return [pa.Table.from_arrays([q, pa.array(i, schema.field(1).type), pa.array(s, pa.float64())], schema=schema) for q, i, s in found]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vector_col: str, few_queries: int = FEW_QUERIES, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id_col, score: for each query its k best of all ``vectors``, and some that others found elsewhere beat.

    The vectors are read once, however many queries there are. Up to ``few_queries`` (they are counted) go to every
    task, and the vectors stay where they are; beyond that, queries are dealt over as many lanes as tasks run at
    once (more beyond LANE_QUERIES a lane), and each lane's task sees every vector once, so what is shuffled grows with
    the vectors, not with their square (the products do). A task holds its lane's queries with k rows each in groups of
    group_queries, block_rows vectors and a product of group_queries by SLICE numbers.
    Nearness by a matrix product chooses candidates, with a margin for rounding; their scores are then summed pair by
    pair. Vectors that are null or not finite, and pairs of different lengths, give no hit.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).filter("query_id is not null")
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter("id is not null")
    out = asked.select("query_id").schema.add(id_col, own.schema["id"].dataType).add("score", "double")
    schema = to_arrow_schema(out)
    n = asked.count()
    if n <= few_queries:
        table = vectors.sparkSession.sparkContext.broadcast(asked.toArrow())  # at most few_queries rows

        def run(batches):
            met = _asking(table.value, k, metric)
            for b in batches:
                _met(met, b.column("id"), b.column("vector"))
            for t in _answers(met, schema):
                yield from t.to_batches(10_000)

        return own.mapInArrow(run, out)
    lanes = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // LANE_QUERIES))
    kind = own.schema["vector"].dataType
    left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(lanes)).cast("int").alias("lane"), F.lit(False).alias("met"), "query_id", "query_vector", F.lit(None).cast(own.schema["id"].dataType).alias("id"), F.lit(None).cast(kind).alias("vector"))
    right = own.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(True).alias("met"), F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast("array<double>").alias("query_vector"), "id", "vector")

    def lane(batches):
        groups, waiting = [], []

        def grouped():
            while sum(t.num_rows for t in waiting) > 0:
                some = pa.concat_tables(waiting)
                groups.append(_asking(some.slice(0, group_queries), k, metric))
                waiting[:] = [some.slice(group_queries)]

        for whole in batches:
            asks = whole.num_rows - (pa.compute.sum(whole.column("met")).as_py() or 0)  # these come first
            if asks:
                waiting.append(pa.Table.from_batches([whole.slice(0, asks)]).select(["query_id", "query_vector"]))
            for s in range(asks, whole.num_rows, block_rows):
                grouped()
                b = whole.slice(s, block_rows)
                for met in groups:
                    _met(met, b.column("id"), b.column("vector"))
        for met in groups:
            for t in _answers(met, schema):
                yield from t.to_batches(10_000)

    return left.unionByName(right).repartitionById(lanes, F.col("lane")).sortWithinPartitions("met").mapInArrow(lane, out)
