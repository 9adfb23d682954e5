import random

import pytest

from loomwright.operators.bm25 import StoredIndex
from loomwright.sources import files, sinks
from loomwright.streaming.ingestion import append_new, bloom, ingest, may_hold

SCHEMA = "chunk_id string, organization_id string, namespace string, content string, embedding array<float>"


def store(spark, path):
    rows = [(f"{o}-{n}-{k}", o, n, f"text {k} of {o}", [float(k), 1.0]) for o in ("a/b", "b", "c d") for n in ("policy", "talent") for k in range(20)]
    sinks.save_store(spark.createDataFrame(rows, SCHEMA).repartition(2), path)
    return rows


def folder(version, o, n):
    from pathlib import Path

    return next(Path(version).glob(f"organization_id={o}/namespace={n}"))


def test_a_damaged_scope_fails_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = store(spark, path)
    version = sinks.current_version(spark, path)
    own = files.load_store(spark, path, "a/b", "policy", 2)
    assert sorted(r.chunk_id for r in own.collect()) == sorted(r[0] for r in rows if r[1:3] == ("a/b", "policy"))
    assert all("organization_id=a%2Fb/namespace=policy/" in f.replace("%252F", "%2F") for f in own.inputFiles()), "only the scope's files are read"
    assert files.load_store(spark, path, "nobody", "policy", 2).count() == 0
    # other bytes in one file of b, talent
    victim = next(folder(version, "b", "talent").glob("*.parquet"))
    good = victim.read_bytes()
    other = tmp_path / "other"
    spark.createDataFrame([("b-talent-0", "changed", [0.0, 1.0])], "chunk_id string, content string, embedding array<float>").coalesce(1).write.parquet(str(other))
    victim.write_bytes(next(other.glob("*.parquet")).read_bytes())
    victim.with_name(f".{victim.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="damaged.*aren't as they were"):
        files.load_store(spark, path, "b", "talent", 2)
    assert files.load_store(spark, path, "b", "policy", 2).count() == 20 == files.load_store(spark, path, "c d", "talent", 2).count()
    victim.write_bytes(b"no parquet at all")
    with pytest.raises(ValueError, match="damaged"):
        files.load_store(spark, path, "b", "talent", 2)
    victim.write_bytes(good)
    assert files.load_store(spark, path, "b", "talent", 2).count() == 20
    victim.with_name("part-added.parquet").write_bytes(good)
    with pytest.raises(ValueError, match="part-added"):
        files.load_store(spark, path, "b", "talent", 2)


def test_a_changed_tree_is_found(spark, tmp_path):
    path = str(tmp_path / "store")
    store(spark, path)
    version = sinks.current_version(spark, path)
    scopes = [r.asDict() for r in spark.read.parquet(f"{version}/_tree/scopes").collect()]
    for s in scopes:
        s["rows"] += 1
    spark.createDataFrame(scopes, spark.read.parquet(f"{version}/_tree/scopes").schema).write.mode("overwrite").parquet(f"{version}/_tree/scopes")
    with pytest.raises(ValueError, match="root"):
        files.load_store(spark, path, "b", "policy", 2)


def test_failed_saves_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("c", "o", "n", "x", [1.0]), ("c", "p", "n", "y", [1.0])], SCHEMA)
    with pytest.raises(ValueError, match="1 repeated"):
        sinks.save_store(rows, path)
    assert not list((tmp_path / "store").glob("version-*"))
    sinks.save_store(rows.limit(0), path)
    assert files.load_store(spark, path, "o", "n", 1).count() == 0


def test_index_of_a_scope_is_kept(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store(spark, path)
    queries = spark.createDataFrame([(0, "text 7"), (1, "c d")], "query_id int, query string")
    first = sinks.scope_index(spark, path, "c d", "policy").search(queries, 3).collect()
    assert {r.doc_id for r in first if r.query_id == 0 and r["rank"] == 1} == {"c d-policy-7"}
    monkeypatch.setattr(StoredIndex, "append", lambda *a, **b: pytest.fail("the index is there"))
    assert sinks.scope_index(spark, path, "c d", "policy").search(queries, 3).collect() == first


def test_filters_hold_their_keys():
    import numpy as np

    r = np.random.default_rng(3)
    keys = r.integers(-(2**63), 2**63 - 1, 5000)
    others = r.integers(-(2**63), 2**63 - 1, 20_000)
    assert may_hold(bloom(keys), keys).all() and may_hold(bloom(keys), others).mean() < 0.01 and not may_hold(bloom(keys[:0]), others).any()


def test_batches_read_only_what_may_hold_their_keys(spark, tmp_path):
    r, path, have = random.Random(2), str(tmp_path / "store"), {}
    for n in range(5):
        keys = [f"k{n}-{k}" for k in range(30)] + r.sample(sorted(have), min(3, len(have))) + [f"k{n}-0"]
        rows = [(k, f"batch {n}") for k in keys] + [(None, "x")]
        done = append_new(spark.createDataFrame(rows, "chunk_id string, content string"), path, f"s{n}")
        fresh = {k for k in keys if k not in have}
        assert done["came"] == len(set(keys)) and done["new"] == len(fresh)
        assert done["parts"] >= done["read"] and done["read"] <= 3 + 3, "the three known keys' parts, and few by chance"
        have |= {k: f"batch {n}" for k in fresh}
        if n == 3:  # the batch runs again
            assert append_new(spark.createDataFrame(rows, "chunk_id string, content string"), path, "s3") == done
    assert {(x.chunk_id, x.content) for x in spark.read.parquet(path).collect()} == set(have.items()) and spark.read.parquet(path).count() == len(have)
    done = append_new(spark.createDataFrame([("new", "y")], "chunk_id string, content string"), path, "s9")
    assert done["read"] == 0 and done["parts"] > 60, "a new key opens no part of the store"


def test_stream_twice(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(f"k{(n * 5 + k) % 12}",) for k in range(8)], "chunk_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream, seen = spark.readStream.schema("chunk_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), []
    for check in "ab":
        assert ingest(stream, str(tmp_path / "store"), str(tmp_path / check), report=seen.append).awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 12
    assert sum(x["new"] for x in seen[:3]) == 12 and sum(x["new"] for x in seen[3:]) == 0
