"""Exact de-duplication with an extendible-hash index on shared files.

Texts are keyed by a 64-bit hash. A directory maps the leading bits of a key to a bucket: where a
bucket holds more keys than its capacity it is split by the next bit, and the directory doubles when
a bucket is as deep as the directory. Runs of neighbouring buckets (key ranges) belong to owner tasks.
An owner walks its keys in order; texts with one key form a chain, told apart by comparing them byte
by byte. Owners write the entries (with their texts) and the members to Parquet in the shared folder.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_hot_apart, stored, text_or_empty

CAPACITY, MOST_BUCKETS, FIRST_BITS = 4096, 16_384, 14
HELD_CHARS, IDS_A_ROW, OWNER_BYTES = 32_000_000, 4096, 128_000_000


class Directory:
    """Buckets in key order. ``count(depth, within)`` gives the numbers of distinct keys by their first
    ``depth`` bits, only below the prefixes ``within`` = (depth, prefixes) if given."""

    def __init__(self, count, capacity: int, step: int = FIRST_BITS):
        self.buckets: list[tuple[int, int, int]] = []  # depth, prefix, keys
        depth, tops = step, None
        found = count(depth, None)
        tops = [(0, 0)]
        while tops:
            deeper = []
            for top in tops:
                self._split(*top, found, depth, capacity, deeper)
            if not deeper:
                break
            within, depth = depth, min(64, depth + step)
            found = count(depth, (within, [p for _, p in deeper]))
            tops = deeper
        self.buckets.sort(key=lambda b: b[1] << (64 - b[0]))
        self.depth = max(b[0] for b in self.buckets)

    def _split(self, depth, prefix, found, at, capacity, deeper):
        low, high = prefix << (at - depth), (prefix + 1) << (at - depth)
        own = {p: n for p, n in found.items() if low <= p < high} if depth else found
        todo = [(depth, prefix, own)]
        while todo:
            d, p, keys = todo.pop()
            n = sum(keys.values())
            if n <= capacity or d == 64:
                self.buckets.append((d, p, n))
            elif d == at:
                deeper.append((d, p))
            else:
                half = ((p << 1) | 1) << (at - d - 1)
                todo += [(d + 1, p << 1, {k: v for k, v in keys.items() if k < half}), (d + 1, (p << 1) | 1, {k: v for k, v in keys.items() if k >= half})]

    def lows(self) -> list[int]:
        """The least key (unsigned) of each bucket."""
        return [p << (64 - d) for d, p, _ in self.buckets]

    def owners(self, n: int) -> list[int]:
        """The owner of each bucket: runs of buckets with about as many keys."""
        total, run, out = max(1, sum(k for *_, k in self.buckets)), 0, []
        for *_, k in self.buckets:
            out.append(min(n - 1, (run + k // 2) * n // total))
            run += k
        return out


def _combine(lows: list[int], owners: list[int], hot, n_owners: int, out: pa.Schema):
    """Rows of one task with equal texts become one (kind 1: what the key's owner needs), with their ids beside
    (kind 0), some thousand a row. Those of ``hot`` keys (a broadcast, sorted) go to one of n_owners sub-owners first, by
    key and task."""

    def run(batches):
        import numpy as np

        low, owner = np.array(lows, np.uint64), np.array(owners, np.int32)
        part, seq, held, chains = TaskContext.get().partitionId(), 0, 0, {}

        def emit(rows):
            for k in range(0, len(rows), 512):
                cols = zip(*rows[k : k + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, out, strict=True)], schema=out)

        def members(e):
            return 0, None, None, None, part, e["seq"], None, e["ids"], None, None, e["n"]

        def flush():
            found = [(k, t, e) for k, chain in chains.items() for t, e in chain]
            keys = np.array([k for k, *_ in found], np.int64)
            at = np.searchsorted(low, keys.view(np.uint64), "right") - 1
            to, often = owner[at], hot.value
            if len(often):
                is_hot = often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys
                to = np.where(is_hot, n_owners + ((keys.view(np.uint64) >> np.uint64(32)).astype(np.int64) + part) % n_owners, to)
            heads = [(1, o, b, k, part, e["seq"], t, None, e["best"], e["pos"], e["n"] + len(e["ids"])) for (k, t, e), o, b in zip(found, to.tolist(), at.tolist(), strict=True)]
            yield from emit(heads + [members(e) for *_, e in found if e["ids"]])

        for b in batches:
            full = []
            for i, key, text in zip(*(b.column(c).to_pylist() for c in ("id", "key", "text")), strict=True):
                chain = chains.setdefault(key, [])
                for known, e in chain:
                    if known == text:
                        break
                else:
                    e = {"seq": seq, "ids": [], "n": 0, "best": None, "pos": 0}  # n: ids that are out already
                    chain.append((text, e))
                    seq += 1
                    held += len(text) + 300
                if i is not None and (e["best"] is None or i > e["best"]):
                    e["best"], e["pos"] = i, e["n"] + len(e["ids"])
                e["ids"].append(i)
                if len(e["ids"]) >= IDS_A_ROW:
                    full.append(members(e))
                    e["n"], e["ids"] = e["n"] + len(e["ids"]), []
            yield from emit(full)
            if held > HELD_CHARS:
                yield from flush()
                held, chains = 0, {}
        if chains:
            yield from flush()

    return run


def _meet(owners: list[int], out: pa.Schema):
    """A sub-owner's walk over hot keys in order: of tasks with the same text the one with the best id stands for all
    (kind 1, for the key's owner), and each of the others names that one (kind 0)."""

    def run(batches):
        rows, key, chain, bucket = [], None, [], 0

        def close():
            for text, best, (part, seq, pos), n, tasks in chain:
                rows.append((1, owners[bucket], bucket, key, part, seq, text, best, pos, n, None, None))
                rows.extend((0, None, None, None, p, q, None, None, None, None, part, seq) for p, q in tasks if (p, q) != (part, seq))

        def emit():
            for k in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[k : k + 512], strict=True), out, strict=True)], schema=out)
            rows.clear()

        for b in batches:
            for bkt, k, part, seq, text, best, pos, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "part", "seq", "text", "best", "pos", "n")), strict=True):
                if k != key:
                    close()
                    yield from emit()
                    key, chain, bucket = k, [], bkt
                entry = next((e for e in chain if e[0] == text), None)
                if entry is None:
                    chain.append([text, best, (part, seq, pos), n, [(part, seq)]])
                    continue
                if best is not None and (entry[1] is None or best > entry[1]) or best == entry[1] and (part, seq) < entry[2][:2]:
                    entry[1:3] = best, (part, seq, pos)
                entry[3] += n
                entry[4].append((part, seq))
        close()
        yield from emit()

    return run


def _own(out: pa.Schema):
    """An owner's walk over its keys in order: a row for each task's text (kind 0), an entry for each text (kind 1)."""

    def run(batches):
        rows, size = [], 0
        key, chain, bucket = None, [], 0

        def close():
            for n, (text, best, where, total) in enumerate(chain):
                rows.append((1, bucket, key, n, *where[:2], best, where[2], total, hashlib.sha256(text.encode()).hexdigest(), text))

        def emit():
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, out, strict=True)], schema=out)

        for b in batches:
            for bkt, k, part, seq, text, best, pos, count in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "part", "seq", "text", "best", "pos", "n")), strict=True):
                if k != key:
                    close()
                    key, chain, bucket = k, [], bkt
                n = next((n for n, e in enumerate(chain) if e[0] == text), len(chain))
                if n == len(chain):
                    chain.append([text, best, (part, seq, pos), 0])
                    size += len(text)
                entry = chain[n]
                entry[3] += count
                if best is not None and (entry[1] is None or best > entry[1]) or best == entry[1] and (part, seq) < entry[2][:2]:
                    entry[1:3] = best, (part, seq, pos)
                rows.append((0, bkt, k, n, part, seq, None, None, None, None, None))
                if len(rows) >= 2000 or size > 4_000_000:
                    yield emit()
                    rows.clear()
                    size = 0
        close()
        if rows:
            yield emit()

    return run


class ExactIndex:
    """The index of one table: ``entries`` (bucket, key, chain, keep_id, group_size, text_sha256, text), read from
    shared files, and the ids of each task's texts (``members``)."""

    def __init__(self, directory: Directory, rows: DataFrame, members: DataFrame):
        self.directory, self.rows, self.members = directory, rows, members
        self.entries = rows.filter("kind = 1").selectExpr("bucket", "key", "chain", "best AS keep_id", "total AS group_size", "sha AS text_sha256", "text")

    def groups(self, id_col: str = "doc_id") -> DataFrame:
        """A row for each row of the table: id_col, keep_id, group_size, kept, text_sha256."""
        entries = self.rows.filter("kind = 1").selectExpr("key", "chain", "part AS keep_part", "seq AS keep_seq", "pos AS keep_pos", "best AS keep_id", "total AS group_size", "sha AS text_sha256")
        where = join_hot_apart(self.rows.filter("kind = 0").select("key", "chain", "part", "seq"), entries, ["key", "chain"]).drop("key", "chain")
        joined = self.members.join(where, ["part", "seq"])  # a task's text: packed ids on one side, one row on the other
        rows = joined.select("part", "seq", "n", "keep_part", "keep_seq", "keep_pos", "keep_id", "group_size", "text_sha256", F.posexplode("ids").alias("at", "id"))
        kept = (F.col("part") == F.col("keep_part")) & (F.col("seq") == F.col("keep_seq")) & (F.col("n") + F.col("at") == F.col("keep_pos"))
        return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")

    def probe(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with keep_id and group_size of the entry with the same bytes (null where there is none)."""
        found = self.entries.select(F.col("key").alias("_k"), F.col("text").alias("_t"), "keep_id", "group_size")
        text = text_or_empty(text_col)
        return docs.join(found, (F.xxhash64(text) == F.col("_k")) & (text == F.col("_t")), "left").drop("_k", "_t")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, owners: int | None = None, key=None, hot_bytes: int = OWNER_BYTES) -> ExactIndex:
    """Index every row and whole text of ``docs``.

    A null text counts as empty; texts are equal when their bytes are. Of equal texts the row with the
    largest id stays; null ids are below all others, and of rows that repeat that id (or if all are
    null) exactly one stays. Other columns aren't read; an empty table gives an empty index.
    ``capacity`` is that of a bucket in distinct keys (by default 4096, or more so that there are at
    most some 32,000 buckets) and ``owners`` the number of owner tasks (by default one for each 128 MB of text,
    or the shuffle partitions if these are more); ``key`` replaces the 64-bit hash, for tests. Copies within a task
    become one row and their ids stay in the task's files. A key whose rows have over ``hot_bytes`` of text (there are no
    more such keys than owners) goes through sub-owners, by key and task, so its owner gets each text once a
    sub-owner and no sub-owner more than its share of the tasks; no owner gets ids.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text")).withColumn("key", key(F.col("text")) if key else F.xxhash64("text"))
    keys = stored(base.groupBy("key").agg(F.sum(F.octet_length("text").cast("long")).alias("size")), "index-keys")
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if capacity is None:
        capacity = max(CAPACITY, -(-n // MOST_BUCKETS))

    def count(depth, within):
        part = lambda d: F.shiftrightunsigned("key", 64 - d) if d < 64 else F.col("key")
        some = keys.filter(part(within[0]).isin(within[1])) if within else keys
        return {r[0] % 2**64: r[1] for r in some.groupBy(part(depth).alias("p")).count().collect()}  # at most 2 ** step prefixes for each overfull bucket

    directory = Directory(count, capacity)
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNER_BYTES))
    id_type = base.schema["id"].dataType
    kinds = {"kind": T.IntegerType(), "owner": T.IntegerType(), "bucket": T.IntegerType(), "key": T.LongType(), "chain": T.IntegerType(), "part": T.IntegerType(), "seq": T.LongType(), "text": T.StringType(), "ids": T.ArrayType(id_type), "best": id_type, "pos": T.LongType(), "n": T.LongType(), "total": T.LongType(), "sha": T.StringType()}
    schema = lambda names: T.StructType([T.StructField(c, kinds[c]) for c in names.split()])
    sent, index = schema("kind owner bucket key part seq text ids best pos n"), schema("kind bucket key chain part seq best pos total sha text")
    from pyspark.sql.pandas.types import to_arrow_schema

    import numpy as np

    often = np.sort(np.array([r[0] for r in keys.filter(F.col("size") > hot_bytes).select("key").collect()], np.int64))  # at most size / hot_bytes
    of_bucket = directory.owners(owners)
    combined = stored(base.mapInArrow(_combine(directory.lows(), of_bucket, spark.sparkContext.broadcast(often), owners, to_arrow_schema(sent)), sent), "index-combined")
    heads = combined.filter("kind = 1").select("owner", "bucket", "key", "part", "seq", "text", "best", "pos", "n")
    links = None
    if len(often):
        apart = T.StructType([*schema("kind owner bucket key part seq text best pos n").fields, T.StructField("by_part", T.IntegerType()), T.StructField("by_seq", T.LongType())])
        met = heads.filter(F.col("owner") >= owners).repartitionById(owners, F.col("owner") - owners).sortWithinPartitions("bucket", "key").mapInArrow(_meet(of_bucket, to_arrow_schema(apart)), apart)
        met = stored(met, "index-met")
        heads = heads.filter(F.col("owner") < owners).unionByName(met.filter("kind = 1").select(*heads.columns))
        links = met.filter("kind = 0").select("part", "seq", "by_part", "by_seq")
    owned = heads.repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "key").mapInArrow(_own(to_arrow_schema(index)), index)
    rows = stored(owned, "exact-index")
    if links is not None:  # a task that another stands for has that one's place
        place = rows.filter("kind = 0").select("bucket", "key", "chain", F.col("part").alias("by_part"), F.col("seq").alias("by_seq"))
        rows = rows.unionByName(links.join(place, ["by_part", "by_seq"]).select(F.lit(0).alias("kind"), "bucket", "key", "chain", "part", "seq", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("best", "pos", "total", "sha", "text"))))
    return ExactIndex(directory, rows, combined.filter("kind = 0").select("part", "seq", "n", "ids"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, as ``ExactIndex.groups`` gives them; see ``build_index``."""
    return build_index(docs, id_col, text_col).groups(id_col)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
