import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from loomwright.operators import cache as C
from loomwright.operators import chunks as K
from loomwright.operators import evaluation as E
from loomwright.operators import memory as M
from loomwright.operators import metrics
from loomwright.operators import relational as R
from loomwright.sources import files, sinks
from loomwright.streaming import rate_limit, windows

NOW = datetime.datetime(2024, 1, 1, 12)


def users(spark):
    return spark.createDataFrame([(1, "ann", "o", "admin", 1), (2, "bob", "o", "viewer", 1), (3, "cat", "p", "admin", 1), (4, "dan", "p", "admin", 0)], "id int, username string, organization_id string, role string, is_active int")


def test_last_admin_and_tenant(spark):
    u = users(spark)
    role = lambda df: {r.id: (r.role, r.is_active) for r in df.collect()}
    assert role(R.changed_user(u, "o", 1, role="viewer"))[1] == ("admin", 1), "the last active admin stays"
    assert role(R.changed_user(u, "p", 3, active=0))[3] == ("admin", 1) and 3 in role(R.changed_user(u, "p", 3, delete=True))
    assert role(R.changed_user(u, "o", 2, role="admin"))[2] == ("admin", 1)
    assert role(R.changed_user(u, "p", 2, delete=True)) == role(u), "another tenant's user can't be changed"
    assert 2 not in role(R.changed_user(u, "o", 2, delete=True))


def test_access_requests(spark):
    rows = [(1, 2, "viewer", "pending", 1), (2, 2, "viewer", "pending", 2), (3, 1, "viewer", "pending", 1), (4, 3, "viewer", "approved", 1)]
    requests = spark.createDataFrame(rows, "id int, user_id int, from_role string, status string, created_at int")
    assert {r.id for r in R.one_pending_each(requests).collect()} == {1, 3, 4}
    decisions = spark.createDataFrame([(1, True), (3, True), (2, False)], "id int, approved boolean")
    assert {r.id: r.status for r in R.decided(requests, users(spark), decisions).collect()} == {1: "approved", 2: "rejected", 3: "rejected", 4: "approved"}


def test_lockout(spark):
    rows = [("a", NOW + datetime.timedelta(minutes=k), False) for k in range(5)] + [("b", NOW, False), ("b", NOW + datetime.timedelta(minutes=9), True)]
    got = R.locked_out(spark.createDataFrame(rows, "username string, ts timestamp_ntz, ok boolean")).collect()
    assert [(r.username, r.locked_until) for r in got] == [("a", NOW + datetime.timedelta(minutes=34))]


def test_audit_filters_are_values_not_sql(spark):
    audit = spark.createDataFrame([(1, "x' OR '1'='1", "o", "login", NOW), (2, "ann", "o", "login", NOW)], "id int, username string, organization_id string, action string, timestamp timestamp_ntz")
    assert [r.id for r in R.audit_search(audit, "o", username="x' OR '1'='1").collect()] == [1]
    assert R.audit_search(audit, "o", start=NOW, end=NOW - datetime.timedelta(days=1)).count() == 0
    assert R.audit_search(audit, limit=0).count() == 1


def test_cache(spark):
    cols = "organization_id string, namespace string, user_id string, role string, query_text string, answer string, hits int, query_embedding array<double>, created_at timestamp_ntz, last_accessed timestamp_ntz, updated_at timestamp_ntz"
    old = NOW - datetime.timedelta(hours=1)
    cache = C.with_hash(spark.createDataFrame([("o", "policy", "u", None, "What is  Leave", "20 days", 3, [1.0, 0.0], NOW, NOW, NOW), ("o", "policy", "u", None, "stale", "old", 1, [0.0, 1.0], old, old, old), ("p", "policy", "u", None, "x", "secret", 1, [1.0, 0.01], NOW, NOW, NOW)], cols))
    asked = spark.createDataFrame([(1, "o", "policy", "u", None, "what is leave", None), (2, "o", "policy", "u", None, "how much leave", [0.99, 0.05]), (3, "o", "policy", "v", None, "what is leave", [1.0, 0.0]), (4, "o", "policy", "u", None, "stale", [0.0, 1.0])], "request_id int, organization_id string, namespace string, user_id string, role string, query_text string, query_embedding array<double>")
    got = {r.request_id: (r.answer, r.kind) for r in C.lookup(asked, cache, NOW + datetime.timedelta(seconds=5)).collect()}
    assert got == {1: ("20 days", "exact"), 2: ("20 days", "semantic")}
    new = cache.limit(1).withColumn("answer", F.lit("25 days")).withColumn("hits", F.lit(0))
    after = {r.query_text: (r.answer, r.hits) for r in C.stored(cache, new).collect()}
    assert after["What is  Leave"] == ("25 days", 3) and len(after) == 3
    assert C.cleared(cache, "o", "policy").count() == 1


def test_memory(spark):
    rows = [(1, k, "user", "word " * 4) for k in range(30)] + [(2, 0, "user", "z" * 1000), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    kept = M.within_budget(df, 15).collect()
    assert sorted((r.conv_id, r.turn) for r in kept) == [(1, 27), (1, 28), (1, 29), (2, 0)]
    assert next(len(r.text) for r in kept if r.conv_id == 2) == 60
    short = [r for r in M.compressed(df).orderBy("turn").collect() if r.conv_id == 1]
    assert len(short) == 7 and short[0].role == "system" and short[0].text.startswith(M.SUMMARY_HEAD) and short[-1].turn == 29
    told = [("user", " y" * 450), (None, "kept"), ("assistant", ""), ("user", "z" * 501)]
    rows = [(4, k, "user", "y" * 900) for k in range(30)] + [(5, k, "user", " ") for k in range(30)] + [(6, k, *(told[k] if k < 4 else ("user", "late"))) for k in range(20)]
    got = {r.conv_id: r.text for r in M.compressed(spark.createDataFrame(rows, df.schema)).filter("role = 'system'").collect()}
    entry = "- USER: " + "y" * 500 + "…"
    whole = M.SUMMARY_HEAD + "\n".join([entry] * 8)
    assert got[4] == whole[: M.MOST_SUMMARY] + "…" and got[5] == M.NO_SUMMARY
    assert got[6] == M.SUMMARY_HEAD + "\n".join(["- USER: " + ("y " * 250).rstrip() + "…", "- UNKNOWN: kept", "- USER: " + "z" * 500 + "…", *["- USER: late"] * 10])


def test_evaluation_by_hand(spark):
    rows = spark.createDataFrame([("How many leave days", "Twenty leave days", ["Employees get twenty leave days", "Other"], "twenty leave days"), ("q", "", [], "")], "question string, answer string, contexts array<string>, ground_truth string")
    got = E.evaluated(rows).collect()
    assert [got[0][m] for m in E.METRICS] == [1.0, pytest.approx(2 / 3), pytest.approx((2 / 3) / 1.5), 1.0]
    assert [got[1][m] for m in E.METRICS] == [0.0, 0.0, 0.0, 0.0]
    assert E.batch_summary(E.evaluated(rows)).first().n_faithfulness == 2


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([], "latency double, cost double, cache_hit boolean, error boolean")
    assert metrics.health(none).first().cache_hit_pct == 0 and metrics.dashboard(none).first().hit_rate == 0 == metrics.engine_stats(none).first().hit_rate


def test_chunks_cover_the_text(spark):
    text = "First sentence here. " * 30 + "\n\n" + "Second part, 3.5 units. " * 20
    docs = spark.createDataFrame([(1, text), (2, "  short "), (3, ""), (4, None), (5, "x" * 1000)], "doc_id int, text string")
    for merge in (False, True):
        got = {}
        for r in K.chunked(docs, merge=merge).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append(r)
            if not merge:
                assert r.content == (text if r.doc_id == 1 else docs.filter(f"doc_id = {r.doc_id}").first().text)[r.char_start : r.char_end]
            assert r.char_length == len(r.content) <= 300 + 60
        assert got.keys() == {1, 2, 5} and got[2][0].content == "short"
        covered = set().union(*(range(r.char_start, r.char_end) for r in got[1]))
        assert all(k in covered or text[k].isspace() for k in range(len(text)))
    assert len(K.spans("a" * 300, parity=True)) == 31 and len(K.spans("a" * 300)) == 1 and len(K.spans("a" * 20, parity=True)) == 20
    with pytest.raises(ValueError):
        K.chunked(docs, size=10, overlap=10)
    half = "a" * 150 + "\n\nb. " + "c" * 300
    assert K.spans(half)[0][3] == 154, "a break that begins at the middle isn't beyond it"
    assert K.spans("a" * 151 + "\n\nb. " + "c" * 300)[0][3] == 151
    assert K.spans("x" * 298 + "1.5" + "y" * 50)[0][3] == 300 and K.spans("x" * 296 + "1.5. " + "y" * 50)[0][3] == 300


def test_rate_limit(spark):
    at = [0, 10, 20, 30, 61, 62, 75, 200]
    rows = [(k, "u", NOW + datetime.timedelta(seconds=s)) for k, s in enumerate(at)] + [(100, "v", NOW)]
    got = {r.event_id: r.accepted for r in rate_limit.limited(spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz"), limit=3).collect()}
    assert [got[k] for k in range(8)] == [True, True, True, False, True, False, True, True] and got[100]


def test_streams(spark, tmp_path):
    rows = [(k, "u", NOW + datetime.timedelta(seconds=k), float(k)) for k in range(6)]
    spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id string, ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a processing-time timeout would go on for ever
    try:
        q = rate_limit.limited_stream(stream, limit=4).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [r.accepted for r in spark.table("limited").orderBy("event_id").collect()] == [True] * 4 + [False] * 2
    for _ in range(2):
        windows.ingest(stream.selectExpr("cast(event_id % 3 AS string) AS chunk_id"), str(tmp_path / "store"), str(tmp_path / f"check{_}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3


def test_files(spark, tmp_path):
    word = 'xmlns:w="w"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {word}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<workbook><sheets><sheet name='S1'/></sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>one</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData><row><c t='s'><v>0</v></c><c/><c><v>2</v></c></row><row><c/></row></sheetData></worksheet>")
    with zipfile.ZipFile(tmp_path / "c.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<s><a:p xmlns:a='a'><a:t>Slide text</a:t></a:p></s>")
    (tmp_path / "d.txt").write_bytes(b"caf\xff plain")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.zzz").write_bytes(b"x")
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    (tmp_path / "h.txt").write_bytes(b"")
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in files.read_files(spark, str(tmp_path), pdf=lambda b: "few words", ocr=lambda b: "from the image").collect()}
    texts = {k: v[0] for k, v in got.items()}
    assert texts["a.docx"] == "Hello\na | b" and texts["b.xlsx"] == "[Sheet: S1]\none | 2" and texts["c.pptx"] == "[Slide 1]\nSlide text"
    assert texts["d.txt"] == "caf\ufffd plain" and texts["g.pdf"] == "from the image"
    assert "BadZipFile" in got["e.docx"][1] and "unsupported" in got["f.zzz"][1]
    assert "h.txt" not in got, "Spark reads no empty files"


def test_store_and_sinks(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("c1", "o", "policy", [1.0]), ("c2", "o", "policy", [2.0])], "chunk_id string, organization_id string, namespace string, embedding array<double>")
    sinks.save_store(rows, path)
    sinks.save_store(rows.limit(1), path)
    assert files.load_store(spark, path, "o", "policy", 1).count() == 1
    with pytest.raises(ValueError, match="repeated"):
        sinks.save_store(rows.unionByName(rows), path)
    assert files.load_store(spark, path, "o", "policy", 1).count() == 1, "a failed save changes nothing"
    with pytest.raises(ValueError, match="damaged"):
        files.load_store(spark, path, "o", "policy", 2)
    copy = sinks.backup(spark, path, str(tmp_path / "copy"))
    assert (tmp_path / "copy").exists() and "organization_id=o" in "".join(spark.read.parquet(copy).inputFiles())
    assert files.load_store(spark, str(tmp_path / "copy"), "o", "policy", 1).count() == 1
    next((tmp_path / "copy").glob("version-*/organization_id=o/namespace=policy/*.parquet")).unlink()
    with pytest.raises(ValueError, match="damaged"):
        files.load_store(spark, str(tmp_path / "copy"), "o", "policy", 1)
    with pytest.raises(FileNotFoundError):
        files.load_store(spark, str(tmp_path / "none"), "o", "policy", 1)
    found = files.accepted_files(spark.createDataFrame([("a.txt", 0), ("b.txt", 5), ("c.txt", 10**9), ("d.zzz", 5)], "path string, length long").withColumn("content", F.lit(None).cast("binary")))
    assert [r.problem for r in found.collect()] == ["empty", None, "too large", "unsupported type"]
    (tmp_path / "gt.json").write_text('[{"question": "q", "ground_truth": "a"}, {"question": "", "ground_truth": "a"}, {"question": "only"}]')
    assert files.read_ground_truth(spark, str(tmp_path / "gt.json")).count() == 1
    (tmp_path / "mem.json").write_text('{"user_id": "u", "organization_id": "o", "messages": [{"role": "user", "content": "hi", "timestamp": "t"}, {"role": "hacker", "content": "x", "timestamp": "t"}]}')
    assert files.read_memory(spark, str(tmp_path / "mem.json"), "u", "o").count() == 1 and files.read_memory(spark, str(tmp_path / "mem.json"), "v", "o").count() == 0
    sinks.write_memory(spark.createDataFrame([("u", "o", "user", "a", "1"), ("u", "o", "assistant", "b", "2")], "user_id string, organization_id string, role string, content string, timestamp string"), str(tmp_path / "out"))
    assert [r.content for r in files.read_memory(spark, str(tmp_path / "out"), "u", "o").collect()] == ["a", "b"]
    ics = sinks.calendar(spark.createDataFrame([("1", "Talk, with; care", NOW, 30)], "uid string, title string, start timestamp_ntz, minutes int")).first().ics
    assert "DTEND:20240101T123000" in ics and "SUMMARY:Talk\\, with\\; care" in ics
