"""The registered queries over the smallest tables, against their SQL or against libraries and brute force."""

import glob
import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomwright.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def _documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1(spark):
    docs, labels = _documents(spark), spark.read.parquet(f"{SF}/labels.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op1_quality"](spark, SF).collect()}
    assert got.keys() == docs.keys() and all(0 < r.evidence < 1 and 0 < r.posterior < 1 and r.keep == (r.posterior <= 0.5) for r in got.values())
    right = sum(got[x.doc_id].keep == (x.quality == 1 and x.toxic == 0) for x in labels)
    assert right >= 0.85 * len(labels), "fitted on some 90 labels only; test_quality.py holds labels out of a larger table"


def test_op2(spark):
    import base64

    import tiktoken

    P = pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    docs = _documents(spark)
    got = queries.QUERIES["op2_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r[1:4] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_op3(spark):
    docs = _documents(spark)
    got = queries.QUERIES["op3_kd_shards"](spark, SF).collect()
    shards = defaultdict(list)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards[r.shard].append((r.slot, r["size"]))
    assert len(got) == len(docs) and set(shards) == set(range(16))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in shards.values())
    sizes, largest = [sum(n for _, n in x) for x in shards.values()], max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= 2 * largest, "each of the four halvings is off by half a text at most"


def test_op7(spark):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = _documents(spark)
    pieces, places = defaultdict(list), []
    for r in queries.QUERIES["op7_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        places.append((r.sequence_id * 2048 + r.offset, r.length))
        assert r.offset + r.length <= 2048
    assert pieces.keys() == docs.keys()
    for i, text in docs.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    end = 0
    for place, length in sorted(places):
        assert place == end
        end += length


def test_op8(spark):
    import sentencepiece

    P = pytest.importorskip("public_tokenizers")
    t, docs = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), _documents(spark)
    got = queries.QUERIES["op8_token_counts"](spark, SF).collect()
    want = {i: (len(x.encode()), n := len(t.encode(x)), n > 4096) for i, x in docs.items()}
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
