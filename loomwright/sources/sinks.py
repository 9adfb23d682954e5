"""Writers: stores, metrics, shortlists, calendars, backups."""

from __future__ import annotations

import json
import uuid
from typing import TYPE_CHECKING

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..operators.bm25 import StoredIndex


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside and renamed over the old one."""
    jvm, beside = spark._jvm, f"{path}.{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, beside)
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    modes = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(p), context.makeQualified(target), modes)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


SCOPE = ["organization_id", "namespace"]


def _leaves(chunks: DataFrame) -> DataFrame:
    """A row for each file of a version: its scope, name, rows, shortest and longest vector and a sum of hashes of
    ids, contents and vectors that no order changes."""
    vector = F.col("embedding") if "embedding" in chunks.columns else F.lit(None).cast("array<float>")
    size = F.when(vector.isNotNull(), F.size(vector))
    own = F.xxhash64(*SCOPE, *[c for c in ("chunk_id", "content") if c in chunks.columns], vector)
    rows = chunks.select(*SCOPE, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), size.alias("size"), own.cast("decimal(38,0)").alias("own"))
    return rows.groupBy(*SCOPE, "file").agg(F.count("*").alias("rows"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("own").alias("hash"))


def _scopes(leaves: DataFrame) -> DataFrame:
    """The tree's next level: for each scope its files, rows and a hash of its leaves, whatever their order."""
    leaf = F.xxhash64("file", "rows", "least", "most", "hash").cast("decimal(38,0)")
    return leaves.groupBy(*SCOPE).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum(leaf).alias("hash"))


def _root(scopes: DataFrame) -> dict:
    files, rows, total = scopes.agg(F.coalesce(F.sum("files"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.sum(F.xxhash64(*SCOPE, "files", "rows", "least", "most", "hash").cast("decimal(38,0)"))).first()
    return {"files": files, "rows": rows, "hash": str(total or 0)}


def save_store(chunks: DataFrame, path: str) -> str:
    """Write a new version of a store: a folder of its own, partitioned by scope, with a hash tree (file, scope, store),
    then the pointer file that names it, in one rename. Readers see the old version or the new one, never a part;
    older versions stay until they are removed. Returns the version's folder. Chunk ids that repeat are an
    error, which leaves nothing behind."""
    spark = chunks.sparkSession
    name = f"version-{uuid.uuid4().hex}"
    version = f"{path}/{name}"
    chunks.write.partitionBy(*SCOPE).parquet(version)
    kept = spark.read.schema(chunks.schema).parquet(version)
    repeated = kept.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.sum(F.col("n") - 1)).first()[0]
    if repeated:
        fs, p = _hadoop(spark, version)
        fs.delete(p, True)
        raise ValueError(f"{repeated} repeated chunk ids")
    _leaves(kept).repartition(*SCOPE).sortWithinPartitions(*SCOPE, "file").write.parquet(f"{version}/_tree/files")
    _scopes(spark.read.parquet(f"{version}/_tree/files")).coalesce(1).write.parquet(f"{version}/_tree/scopes")  # a row for each scope
    root = _root(spark.read.parquet(f"{version}/_tree/scopes"))
    _write_text(spark, f"{version}/_MANIFEST.json", json.dumps({"root": root, "schema": chunks.schema.jsonValue()}))
    _write_text(spark, f"{path}/_CURRENT", name)
    return version


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of a store's current version."""
    name = _read_text(spark, f"{path}/_CURRENT")
    if name is None:
        raise FileNotFoundError(f"no store at {path}")
    return f"{path}/{name}"


def _manifest(spark: SparkSession, version: str) -> dict:
    text = _read_text(spark, f"{version}/_MANIFEST.json")
    if text is None:
        raise ValueError(f"the store is damaged: {version} has no manifest")
    return json.loads(text)


def read_version(spark: SparkSession, version: str) -> DataFrame:
    """A version's rows, by the schema that it was written with."""
    return spark.read.schema(T.StructType.fromJson(_manifest(spark, version)["schema"])).parquet(version)


def read_scope(spark: SparkSession, version: str, organization: str, namespace: str, dim: int | None = None) -> DataFrame:
    """The rows of one scope, after checks up the tree: the store's root agrees with the scopes' nodes, this scope's node
    with its files' leaves, and each of its files with its leaf. No file of another scope is opened."""
    kept = _manifest(spark, version)
    schema = T.StructType.fromJson(kept["schema"])
    own = (F.col("organization_id") == organization) & (F.col("namespace") == namespace)
    scopes = spark.read.parquet(f"{version}/_tree/scopes")
    leaves = spark.read.parquet(f"{version}/_tree/files").filter(own)
    node = scopes.filter(own).collect()
    problem = None
    if _root(scopes) != kept["root"]:
        problem = "its scopes don't agree with its root"
    elif sorted(map(tuple, _scopes(leaves).collect())) != sorted(map(tuple, node)):
        problem = "the scope's files don't agree with its node"
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = f"{version}/organization_id={escape(organization)}/namespace={escape(namespace)}"
    fs, p = _hadoop(spark, folder)
    rows = spark.read.schema(schema).option("basePath", version).parquet(folder) if fs.exists(p) else spark.createDataFrame([], schema)
    if not problem:
        found = _leaves(rows) if fs.exists(p) else leaves.limit(0)
        try:
            wrong = found.exceptAll(leaves).select("file").unionByName(leaves.exceptAll(found).select("file")).distinct().limit(5).collect()
        except (PySparkException, Py4JJavaError) as e:
            raise ValueError(f"the store is damaged: a file of {organization}, {namespace} can't be read") from e
        if wrong:
            problem = "these files aren't as they were written: " + ", ".join(sorted(r.file for r in wrong))
        elif dim is not None and any({n.least, n.most} - {None, dim} for n in node):
            problem = f"its vectors have {node[0].least} to {node[0].most} components, not {dim}"
    if problem:
        raise ValueError(f"the store is damaged or isn't what was asked for: {problem}")
    return rows


def scope_index(spark: SparkSession, path: str, organization: str, namespace: str) -> StoredIndex:
    """The BM25 index of a scope of the store's current version: kept beside the version's data, and made there (after
    the scope's checks) by the first who asks."""
    from ..operators.bm25 import StoredIndex

    version = current_version(spark, path)
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    place = f"{version}/_bm25/{escape(organization)}/{escape(namespace)}"
    try:
        return StoredIndex(spark, place)
    except FileNotFoundError:
        return StoredIndex.append(read_scope(spark, version, organization, namespace).select("chunk_id", "content"), place, "chunk_id", "content")


def backup(spark: SparkSession, path: str, to: str) -> str:
    """A copy of a store's current version as a store of its own, with the same partition layout and a hash tree."""
    return save_store(read_version(spark, current_version(spark, path)), to)


def prometheus_lines(stats: DataFrame, prefix: str = "loomwright") -> DataFrame:
    """stats as ``metric_stats`` gives them, as text lines: value."""
    from ..functions.text import metric_name

    name = F.concat(F.lit(prefix + "_"), metric_name(F.col("name")))
    lines = [F.format_string("%s_count %d", name, F.col("n")), F.format_string("%s_mean %.6f", name, F.col("mean"))]
    lines += [F.format_string(f'%s{{quantile="0.{p}"}} %.6f', name, F.col(f"p{p}")) for p in (50, 90, 95, 99)]
    return stats.select(F.explode(F.array(*lines)).alias("value"))


def write_prometheus(stats: DataFrame, path: str) -> None:
    prometheus_lines(stats).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_memory(messages: DataFrame, path: str, most: int = 10_000) -> None:
    """A JSON object for each user and organisation with the last ``most`` messages in order, as ``read_memory``
    takes them."""
    from ..operators.relational import newest_per_key

    kept = newest_per_key(messages, ["user_id", "organization_id"], [F.col("timestamp").desc()], most)
    rows = kept.groupBy("user_id", "organization_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "role", "content"))).alias("messages"))
    rows.write.mode("overwrite").json(path)


def write_shortlist(ranking: DataFrame, path: str) -> None:
    ranking.write.mode("overwrite").option("header", True).csv(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_search(header: DataFrame, matches: DataFrame, path: str) -> None:
    """One row for the search, one for each match."""
    header.write.mode("append").parquet(f"{path}/talent_searches")
    matches.write.mode("append").parquet(f"{path}/talent_matches")


def calendar(events: DataFrame) -> DataFrame:
    """events(uid, title, start, minutes): iCalendar texts."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    end = F.col("start") + F.make_interval(mins=F.col("minutes"))
    escape = F.regexp_replace("title", r"([,;\\])", r"\\$1")
    text = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("uid")), F.concat(F.lit("DTSTART:"), stamp(F.col("start"))), F.concat(F.lit("DTEND:"), stamp(end)), F.concat(F.lit("SUMMARY:"), escape), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
    return events.select("uid", text.alias("ics"))
