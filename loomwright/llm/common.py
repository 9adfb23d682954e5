"""What the operators of this subpackage share: the shared folder, stored tables, column names."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_HOT, LEAST_HOT = 50_000, 200
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where that is unset and the master is local (single-machine tests) a folder under /tmp/checkpoints is
    used and set on the context; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/loomwright"


def clean(spark: SparkSession) -> None:
    """Remove what these operators have left in the shared folder. DataFrames that they returned can't be read
    any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps start from
    the files, so a lost executor costs no recomputation of what came before. The shuffle files of the write
    go with it, as nothing reads them again; else they would fill the executors' disks until the driver's
    garbage collection."""
    spark = df.sparkSession
    path = path or fresh_path(spark, tag)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def join_hot_apart(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined (inner, left or left_semi) with ``right``, which has at most one row for each key, so that
    no task gets all rows of a hot key.

    Keys that more than 1 in ``MOST_HOT`` of left's rows have (and over ``LEAST_HOT`` rows) are hot: there are at
    most MOST_HOT of these, whatever the data, so right's rows for them are broadcast. All others are joined by a
    shuffle. ``left`` is read three times and should be cheap to read; null keys match nothing.
    """
    n = left.count()
    hot = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(LEAST_HOT, n // MOST_HOT)).select(*keys)
    hot = stored(hot, "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    few = F.broadcast(hot)  # at most MOST_HOT rows
    spread = left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys, how)
    return left.join(few, keys, "left_anti").join(right, keys, how).unionByName(spread)


def fresh(df: DataFrame, base: str, *also: str) -> str:
    """A column name that neither ``df`` has nor ``also`` lists, whatever the case."""
    taken = {c.lower() for c in (*df.columns, *also)}
    while base.lower() in taken:
        base += "_"
    return base


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def rows_of(batches, *names):
    """For each Arrow batch: the batch's columns as Python lists."""
    for b in batches:
        if b.num_rows:
            yield [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]


_MEMORIES: list[dict] = []
_LAST: list = [None]  # the operator that used this worker last, by its memory


def memory() -> dict:
    """A dict for what a Python worker keeps between tasks."""
    _MEMORIES.append({})
    return _MEMORIES[-1]


def begin(own: dict | None = None) -> None:
    """At the start of a task: if another operator used this worker before, drop what it keeps."""
    if own is _LAST[0]:
        return
    _LAST[0] = own
    for d in _MEMORIES:
        if d is not own:
            d.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    import contextlib
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on all systems
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def open_uri(uri: str):
    """The file system and path of a URI as Spark writes it: pyarrow's own ones (file, hdfs, s3, gs, abfss), with
    Hadoop's names for these; a DBFS path by its mount."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif scheme == "dbfs":
        uri = f"/dbfs/{rest.lstrip('/')}"
    elif scheme == "file":
        uri = f"/{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(uri)


class SideFiles:
    """A small table cut into files by ranges of ``per`` keys, for tasks that need some keys' rows beside large rows
    that shouldn't move: each task opens the files of its own keys. A file holds the rows of ``per`` keys and
    is written whole or not at all, by whichever attempt of a task comes last; all write the same."""

    KEPT = 64  # files that a reader keeps

    def __init__(self, table: DataFrame, key: str, per: int, tag: str):
        self.root, self.per = fresh_path(table.sparkSession, tag), per
        self._held: dict[int, list] = {}
        filed = table.withColumn("_file", F.expr(f"cast({key} div {per} as long)"))
        filed.repartition("_file").sortWithinPartitions("_file", *table.columns).mapInArrow(self._write, "file long").count()

    def _write(self, batches):
        def close(file, parts):
            filesystem, path = open_uri(self._name(file))
            filesystem.create_dir(path.rpartition("/")[0], recursive=True)
            beside = f"{path}.{uuid.uuid4().hex}"
            table = pa.Table.from_batches(parts).drop_columns(["_file"])
            with filesystem.open_output_stream(beside) as out, pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table)
            filesystem.move(beside, path)

        file, parts = None, []
        for b in batches:
            files, begin = b.column("_file").to_pylist(), 0
            while begin < len(files):
                end = begin
                while end < len(files) and files[end] == files[begin]:
                    end += 1
                if parts and files[begin] != file:
                    close(file, parts)
                    parts = []
                file = files[begin]
                parts.append(b.slice(begin, end - begin))
                begin = end
        if parts:
            close(file, parts)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["file"])

    def _name(self, file: int) -> str:
        return f"{self.root}/{file:09d}.arrow"

    def columns(self, key: int) -> list:
        """The columns of the file that holds ``key``, as lists; the same object while it is kept."""
        file = key // self.per
        if file not in self._held:
            if len(self._held) >= self.KEPT:
                self._held.clear()
            filesystem, path = open_uri(self._name(file))
            with filesystem.open_input_file(path) as f:
                self._held[file] = [c.to_pylist() for c in pa.ipc.open_file(f).read_all().columns]
        return self._held[file]
