import base64
import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
from loomwright.llm import bpe  # noqa: E402

RANKS = "byte_bpe_50k.tiktoken"
ODD = ["", " ", "a", "  \n\n  x", "don't we'll I'd", "x" * 300, " " * 300, "ab 12 !?" * 50, "é́   z\u0085 中文字 😀😀", "'l" * 90, "a\tb\r\n c   " * 40, "​﻿\x1c\x1d x"]


def reference(texts):
    import tiktoken

    with open(P.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [e.encode_ordinary(t or "") for t in texts]


def random_texts(n):
    r = random.Random(5)
    alphabet = ["a", "B", " ", " ", "\n", "7", "'", "ll", "'s", "é", "!", " ", "中", "word", "😀"]
    return ["".join(r.choices(alphabet, k=r.randrange(0, 400))) for _ in range(n)]


@pytest.mark.parametrize("chunk,overlap,dealt", [(4096, 256, 262_144), (40, 39, 1000), (64, 16, 0), (50, 1, 100)])
def test_same_as_library(spark, chunk, overlap, dealt):
    texts = [None, *ODD, *random_texts(60), "same " * 40, "same " * 40]
    rows = [(None if k == 3 else min(k, len(texts) - 2), t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = bpe.encode_documents(docs, P.path(RANKS), P.PATTERN, chunk_chars=chunk, overlap_chars=overlap, dealt_chars=dealt).collect()
    want = [(r[0], ids) for r, ids in zip(rows, reference(texts), strict=True)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    by = {tuple(ids): (hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(ids)) for t, ids in zip(texts, reference(texts), strict=True)}
    assert all(by[tuple(r.ids)] == (r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in got)


def test_round_trip_and_empty(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    ids = bpe.encode_documents(docs, P.path(RANKS), P.PATTERN, chunk_chars=30, overlap_chars=8, dealt_chars=60)
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode_ids(ids, P.path(RANKS)).collect()}
    assert back == dict(enumerate(ODD))
    assert bpe.encode_documents(docs.limit(0), P.path(RANKS), P.PATTERN).collect() == []


def _codec():
    with open(P.path(RANKS), "rb") as f:
        return bpe.Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, P.PATTERN)


def test_symbols_beside_every_code_point_as_library():
    """Small chunks, so that there are cuts next to all of them: the library's classes count."""
    c = _codec()
    points = [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    for symbol in ("a", "1", "'", "\u20f5", "\u27e2"):
        for k in range(0, len(points), 500):
            text = "".join(f"{symbol}{p}{symbol} x!" for p in points[k : k + 500])
            assert bpe.encode_text(c, text, 64, 16) == c.encode(text), (symbol, k)


def test_cuts_of_random_texts_as_library():
    c, r = _codec(), random.Random(7)
    few = list("aB7 !-\n") + ["'", "'s", "'ll", "  ", "é", "\u2019"]
    for _ in range(3000):
        text = "".join(r.choices(few, k=r.randrange(0, 300)))
        assert bpe.encode_text(c, text, 20, 10) == c.encode(text), text


def test_a_very_long_text(spark):
    """20 MB in one row, twice, dealt over tasks in chunks of the real size."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(1, 9))) for _ in range(5000)]
    text = " ".join(r.choices(words, k=3_500_000))
    assert len(text) > 18_000_000
    docs = spark.createDataFrame([(1, "short"), (2, text), (3, text)], "doc_id long, text string")
    got = {x.doc_id: x for x in bpe.encode_documents(docs, P.path(RANKS), P.PATTERN, with_ids=False).collect()}
    ids = reference([text])[0]
    assert got[2][1:] == got[3][1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert got[1].n_tokens == len(reference(["short"])[0])
