"""Exact top-k by inner product: a Voronoi kNN join.

With M the largest norm, v' = (v, sqrt(M^2 - |v|^2)) and q' = (q, 0), larger inner products are smaller
distances, so the join works in a metric space. Queries and data go to the cells of common pivots.
From summaries of the cells (radius, smallest distances) every query cell gets a distance within which
its queries surely find k neighbours. Query cells are put together to groups and data cells to blocks
(large ones are split), and a group meets a block only if one of its cells may need one of the block's:
then the block gets the group's queries, and the group those vectors that can lie within its distance.
Each meeting is solved by itself and their best are merged.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

LEAST_PIVOTS, MOST_PIVOTS, GROUP_QUERIES, BLOCK_ROWS = 64, 1024, 4096, 32_768
ROWS = "row long, vec_id long, vector binary, dim int, norm2 double"


def _packed(b, scale: float):
    """Of a batch (row, id, v) the rows with a whole finite vector: their indexes, floor(scale * x) of all
    components, and where each row's begin and end."""
    import numpy as np

    v = b.column("v")
    values, offsets = v.values.to_numpy(zero_copy_only=False).astype(np.float64), v.offsets.to_numpy()
    wrong = np.r_[0, np.cumsum(~np.isfinite(values))]  # a null component is NaN here
    good = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False) & (wrong[offsets[1:]] == wrong[offsets[:-1]]))
    with np.errstate(invalid="ignore"):
        return good, np.floor(values * scale), offsets[:-1][good], offsets[1:][good]


def _quantise(scale: float, frame=None, m2: float = 0.0, dim: int = 0, every: int = 1):
    """Packed rows; with a frame of pivots also each row's cell and distance, and those as a query."""

    def run(batches):
        import numpy as np

        for whole in batches:
            for k in range(0, whole.num_rows, 8192):
                b = whole.slice(k, 8192)
                b = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in b.columns], names=b.schema.names)
                good, x, begins, ends = _packed(b, scale)
                if not len(good):
                    continue
                vectors, dims, norms = [], [], []
                for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
                    own = x[i:j]
                    wide = np.abs(own).max(initial=0) >= 2**31
                    vectors.append(own.astype("<i8" if wide else "<i4").tobytes())
                    dims.append(-len(own) if wide else len(own))
                    norms.append(float(own @ own))
                of = pa.array(good)
                columns = [b.column("row").take(of), b.column("id").take(of), pa.array(vectors, pa.binary()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64())]
                names = ["row", "vec_id", "vector", "dim", "norm2"]
                if frame:
                    m = _matrix(vectors, dims, dim)
                    d = _distances(m, np.maximum(m2 - np.array(norms), 0), frame)
                    cell = d.argmin(1)
                    known = columns[1].is_valid().to_numpy(zero_copy_only=False)
                    asks = np.flatnonzero(known & (pc.fill_null(columns[1], 0).to_numpy() % every == 0))  # as 64-bit integers throughout
                    q = _distances(m[asks], np.zeros(len(asks)), frame)
                    ask_cell, ask_far = np.full(len(m), -1), np.zeros(len(m))
                    ask_cell[asks] = q.argmin(1) if len(asks) else -1
                    ask_far[asks] = q[np.arange(len(asks)), ask_cell[asks]]
                    columns += [pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell]), pa.array(ask_cell, pa.int32()), pa.array(ask_far)]
                    names += ["cell", "far", "ask_cell", "ask_far"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _matrix(vectors: list[bytes], dims: list[int], dim: int):
    """Packed rows as float64; shorter ones end in zeros. A negative dim marks 64-bit components."""
    import numpy as np

    if all(d == dim for d in dims):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(vectors), dim))
    for row, v, d in zip(out, vectors, dims, strict=True):
        row[: abs(d)] = np.frombuffer(v, "<i8" if d < 0 else "<i4")
    return out


def _distances(x, extra2, pivots):
    """From rows x with squared extra coordinates to the augmented pivots."""
    import numpy as np

    p, p_extra = pivots
    d2 = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T) + (np.sqrt(extra2)[:, None] - p_extra[None]) ** 2
    return np.sqrt(np.maximum(d2, 0))


def _between(pivots):
    import numpy as np

    p, extra = pivots
    d2 = (p * p).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (p @ p.T) + (extra[:, None] - extra[None]) ** 2
    return np.sqrt(np.maximum(d2, 0))


def bounds(between, near: dict[int, list[float]], radius: dict[int, float], k: int) -> dict[int, float]:
    """The distance within which each query cell's queries find k neighbours besides themselves."""
    import numpy as np

    within = {}
    for c in radius:
        reach = np.sort(np.concatenate([between[c, j] + np.asarray(d) for j, d in near.items()]))
        within[c] = radius[c] + reach[k] if len(reach) > k else math.inf
    return within


def put_together(sizes: dict[int, int], between, most: int) -> list[tuple[list[int], int]]:
    """Runs of cells, in the order of their distances from one pivot, of at most ``most`` rows, each with the number
    of parts that it has: a larger cell is a run by itself, in parts."""
    runs, size = [], most
    for c in sorted(sizes, key=lambda c: (between[0, c], c)):
        if size + sizes[c] > most:
            runs.append(([], 1))
            size = 0
        runs[-1][0].append(c)
        size += sizes[c]
        if sizes[c] > most:
            runs[-1] = (runs[-1][0], -(-sizes[c] // most))
    return runs


class Plan:
    """Which vectors meet which queries, from the cells' summaries alone."""

    def __init__(self, frame, m2, dim, cells, near, asks, k, group_queries, block_rows):
        """cells: rows and radius of each data cell; asks: queries and radius of each query cell."""
        import numpy as np

        between = _between(frame)
        self.frame, self.m2, self.dim = frame, m2, dim
        self.slack = 1e-6 + 4e-9 * (m2**0.5 + 1) + 1e-7 * m2**0.5
        self.reach = {c: x + asks[c][1] for c, x in bounds(between, near, {c: r for c, (_, r) in asks.items()}, k).items()}  # from the query cell's pivot
        self.groups = put_together({c: n for c, (n, _) in asks.items()}, between, group_queries)
        self.blocks = put_together({c: n for c, (n, _) in cells.items()}, between, block_rows)
        self.group_of = {c: g for g, (own, _) in enumerate(self.groups) for c in own}
        self.block_of = {c: b for b, (own, _) in enumerate(self.blocks) for c in own}
        far = np.array([cells[c][1] if c in cells else 0.0 for c in range(len(between))])
        self.meets = [[b for b, (own, _) in enumerate(self.blocks) if any((between[c, own] - far[own] <= self.reach[c] + self.slack).any() for c in group)] for group, _ in self.groups]

    def part(self, rows, parts):
        return (rows * 0x9E3779B1 >> 16) % parts

    def of_queries(self, cells, rows):
        """(index, group, part of it, block, part of it) of each meeting of some queries."""
        for i, (c, r) in enumerate(zip(cells, rows, strict=True)):
            g = self.group_of[c]
            for b in self.meets[g]:
                for part in range(self.blocks[b][1]):
                    yield i, g, self.part(r, self.groups[g][1]), b, part

    def of_vectors(self, cells, rows, x, norm2):
        """The same of some vectors."""
        import numpy as np

        d = _distances(x, np.maximum(self.m2 - norm2, 0), self.frame)
        for g, (group, parts) in enumerate(self.groups):
            reach = np.array([self.reach[c] for c in group])
            for i in np.flatnonzero((d[:, group] <= reach + self.slack).any(1)).tolist():
                b = self.block_of[cells[i]]
                for part in range(parts):
                    yield i, g, part, b, self.part(rows[i], self.blocks[b][1])


def _deal(plan: Plan, queries: bool):
    def run(batches):
        import numpy as np

        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                rows = b.column("row").to_pylist()
                if queries:
                    sent = plan.of_queries(b.column("ask_cell").to_pylist(), rows)
                else:
                    x = _matrix(b.column("vector").to_pylist(), b.column("dim").to_pylist(), plan.dim)
                    sent = plan.of_vectors(b.column("cell").to_pylist(), rows, x, b.column("norm2").to_numpy())
                while some := [m for m, _ in zip(sent, range(8192), strict=False)]:
                    which, *meeting = zip(*some, strict=True)
                    of = pa.array(which)
                    yield pa.RecordBatch.from_arrays([*(pa.array(m, pa.int32()) for m in meeting), *(b.column(c).take(of) for c in ("row", "vec_id", "vector", "dim"))], names=["grp", "gpart", "block", "bpart", "row", "vec_id", "vector", "dim"])

    return run


def _solve(dim: int, k: int):
    schema = pa.schema([("ask", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def best(key, queries, data):
        import numpy as np

        if not queries.num_rows or not data.num_rows:
            return schema.empty_table()
        data = data.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls come last
        rows = data["row"].to_numpy()
        v = _matrix(data["vector"].to_pylist(), data["dim"].to_pylist(), dim)
        asks, q_ids = queries["row"].to_pylist(), queries["vec_id"].to_pylist()
        q = _matrix(queries["vector"].to_pylist(), queries["dim"].to_pylist(), dim)
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * dim < 2**53
        out, at_all = [[], [], []], []
        for s in range(0, len(asks), 128):
            if exact:
                scores = (q[s : s + 128] @ v.T).astype(np.int64)
            else:
                to_int = np.vectorize(int, otypes=[object])
                scores = to_int(q[s : s + 128]) @ to_int(v).T
            for ask, qid, row in zip(asks[s : s + 128], q_ids[s : s + 128], scores, strict=True):
                if exact and len(row) > k + 1:  # at least the best k besides the query's own row
                    at = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1])
                else:
                    at = np.arange(len(row))
                at = at[rows[at] != ask]
                own = row[at]
                order = np.argsort(-own, kind="stable")[:k]  # ids ascend, so ties go to the smaller
                out[0] += [ask] * len(order)
                out[1] += [qid] * len(order)
                at_all.append(at[order])
                out[2] += [int(x) for x in own[order]]
        found = pa.array(np.concatenate(at_all))
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), data["row"].take(found), data["vec_id"].take(found), pa.array(out[2], pa.int64())], schema=schema)

    return best


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k rows with the highest inner products for each query.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``query_every``;
    candidates all other rows, also those with the query's id or a null one; ties go to the smaller id (null
    last); a query gets all if they are fewer than k. Every row counts: of rows that repeat a query's id each
    is a query of its own. Rows with a null vector or null or non-finite components take no part. Shorter vectors
    end in zeros; a score beyond 64 bits is an error. Other columns aren't read; an empty table gives no rows.
    The driver gets the pivots (about the square root of the rows, 64 to 1024) and a summary of each cell. A
    task gets about ``group_queries`` queries and ``block_rows`` vectors at once: larger cells are split.
    """
    import numpy as np

    spark = vectors.sparkSession
    raw = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    packed = raw.mapInArrow(_quantise(scale), ROWS)
    n, dim, m2 = packed.agg(F.count("*"), F.max(F.abs("dim")), F.max("norm2")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    dim = max(dim, 1)
    pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n)))
    chosen = packed.select("vector", "dim", "norm2").orderBy(F.xxhash64("vector"), "vector").limit(pivots).collect()
    p = _matrix([bytes(r["vector"]) for r in chosen], [r["dim"] for r in chosen], dim)
    frame = p, np.sqrt(np.maximum(m2 - np.array([r["norm2"] for r in chosen]), 0))

    data = stored(raw.mapInArrow(_quantise(scale, frame, m2, dim, query_every), f"{ROWS}, cell int, far double, ask_cell int, ask_far double"), "topk-vectors")
    cells = {c: (n, r) for c, n, r in data.groupBy("cell").agg(F.count("*"), F.max("far")).collect()}  # a row for each pivot at most
    asks = {c: (n, r) for c, n, r in data.filter("ask_cell >= 0").groupBy("ask_cell").agg(F.count("*"), F.max("ask_far")).collect()}
    if not asks:
        return empty
    order = Window.partitionBy("cell").orderBy("far")
    near: dict[int, list[float]] = {}
    for c, d in data.select("cell", "far", F.row_number().over(order).alias("nth")).filter(F.col("nth") <= k + 1).select("cell", "far").collect():  # k + 1 rows for each pivot
        near.setdefault(c, []).append(d)
    plan = Plan(frame, m2, dim, cells, near, asks, k, group_queries, block_rows)
    sent = "grp int, gpart int, block int, bpart int, row long, vec_id long, vector binary, dim int"
    meeting = ["grp", "gpart", "block", "bpart"]
    asked = data.filter("ask_cell >= 0").mapInArrow(_deal(plan, True), sent).groupBy(*meeting)
    given = data.mapInArrow(_deal(plan, False), sent).groupBy(*meeting)
    local = asked.cogroup(given).applyInArrow(_solve(dim, k), "ask long, query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), 'bool_and')
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
