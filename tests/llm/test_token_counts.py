import pytest

P = pytest.importorskip("public_tokenizers")
from loomwright.llm.common import fresh_path  # noqa: E402
from loomwright.llm.token_counts import read_cache, token_counts  # noqa: E402
from loomwright.llm.tokenizer_files import TokenizerFile  # noqa: E402


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_and_cache(spark, name):
    texts = ["", None, "two words", "two words", "<s> </s> <|endoftext|>", "é ü 中文 😀", "long " * 5000, " \n "]
    docs = spark.createDataFrame([(None if k == 4 else k // 2, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, content string")
    t = TokenizerFile(spark, P.path(name)).load()
    count = (lambda x: len(t.encode(x))) if name.endswith("model") else (lambda x: len(t.encode(x, add_special_tokens=False).ids))
    want = sorted(((None if k == 4 else k // 2) or -1, len((x or "").encode()), count(x or ""), count(x or "") > 4096) for k, x in enumerate(texts))
    path = fresh_path(spark, "cache")
    for _ in range(2):
        got = token_counts(docs, P.path(name), path).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    version = TokenizerFile(spark, P.path(name)).version
    assert spark.read.parquet(path).count() == read_cache(spark, path, version).count() == 6, "only distinct misses are stored, once"
    token_counts(spark.createDataFrame([(1, "new")], "doc_id long, text string"), P.path(name), path)
    assert read_cache(spark, path, version).count() == 7
    assert read_cache(spark, path, "another version").count() == 0
    assert token_counts(docs.limit(0), P.path(name), path).collect() == []


def test_stored_counts_are_used(spark):
    path = fresh_path(spark, "cache")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    token_counts(docs, P.path("piece_bpe_32k.model"), path)
    doubled = spark.read.parquet(path).selectExpr("content", "n_tokens + 100 AS n_tokens", "tokenizer").collect()
    other = fresh_path(spark, "cache")
    spark.createDataFrame(doubled, "content binary, n_tokens long, tokenizer string").write.partitionBy("tokenizer").parquet(other)
    assert token_counts(docs, P.path("piece_bpe_32k.model"), other).first().n_tokens > 100


@pytest.mark.parametrize("name,pairs,entries", [
    ("word_bpe_49k.json", [("Two  WORDS", "two words"), ("e\u0301t\u00e9", "\u00e9te\u0301"), ("<|STARTOFTEXT|> a", "<|startoftext|> a")], 4),
    ("piece_bpe_32k.model", [("a b", "a\u2581b"), ("x", "x"), ("x ", "x")], 3),
])
def test_one_normal_form_shares_an_entry(spark, name, pairs, entries):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    t = TokenizerFile(spark, P.path(name)).load()
    count = (lambda x: len(t.encode(x))) if name.endswith("model") else (lambda x: len(t.encode(x, add_special_tokens=False).ids))
    path = fresh_path(spark, "cache")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, P.path(name), path).collect()}
    assert got == {r.doc_id: count(r.text) for r in docs.collect()}
    assert spark.read.parquet(path).count() == entries


def test_hot_texts_are_joined_apart(spark):
    rows = [(k, "hot text" if k % 2 else f"text {k}", None) for k in range(1200)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5), P.path("piece_bpe_32k.model"), fresh_path(spark, "cache")).collect()
    t = TokenizerFile(spark, P.path("piece_bpe_32k.model")).load()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(k, len(t.encode(x))) for k, x, _ in rows]
