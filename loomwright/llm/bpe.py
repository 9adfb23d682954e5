"""Byte-level BPE over overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own, from its own start, and
the first boundary that two neighbours share in their overlap is a stitch; the text between stitches is
a piece, which the library encodes by itself. Only boundaries between ASCII characters of two classes are
taken: there the pattern breaks off whatever came before, in every version of Unicode, so pieces give
the ids of the whole text. Short texts go through all of this in one task, batch by batch; the chunks and
pieces of long ones are dealt over the cluster. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import batch, begin, join_hot_apart, memory, rows_of, stored, text_or_empty
from .tokenizer_files import TokenizerFile

CHUNK_CHARS, OVERLAP_CHARS, DEALT_CHARS = 4096, 256, 262_144
_CODECS = memory()


class Codec:
    """The library's encoder for one vocabulary, and the pattern for the chunks' boundaries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.matches = regex.compile(pattern)
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = {i: str(i) for i in ranks.values()}

    def encode(self, text: str) -> list[int]:
        return self.library.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)

    def ids_text(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))

    def boundaries(self, text: str, first: int, last: int) -> list[int]:
        """Where pre-tokens end between the positions ``first`` and ``last``, if the pattern breaks off there
        whatever came before."""
        return [e for m in self.matches.finditer(text) if first <= (e := m.end()) <= last and breaks_off(text, e)]


def _class(c: str) -> int:
    return 0 if c.isalpha() else 1 if c.isdigit() else 2 if c in " \t\n\r\x0b\x0c" else 3


def breaks_off(text: str, at: int) -> bool:
    """Are the characters around ``at`` printable ASCII or white space of two classes, the first neither white space
    nor an apostrophe (which may begin a contraction)?"""
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    return "!" <= a <= "~" and a != "'" and (" " <= b <= "~" or b in "\t\n\r") and _class(a) != _class(b)


def chunks_of(text: str, chunk: int, overlap: int) -> list[str]:
    """The chunks of a text; all but the last go on by ``overlap`` characters into the next."""
    return [text[k : k + chunk + overlap] for k in range(0, max(1, len(text)), chunk)]


def scan_chunk(c: Codec, text: str, i: int, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """The boundaries of chunk ``i``, as positions in the whole text: those in the overlap with the chunk before
    and those in the overlap with the next."""
    ends = c.boundaries(text, 0, len(text))
    return [i * chunk + e for e in ends if e <= overlap], [i * chunk + e for e in ends if e >= chunk]


def stitches(heads: list[list[int]], tails: list[list[int]]) -> list[int]:
    """The cuts between neighbouring chunks: for each pair the first boundary that the tail of one and the head of
    the next share. Pairs that share none get no cut: the piece runs on over both chunks."""
    shared = [set(tails[k - 1]).intersection(heads[k]) for k in range(1, len(heads))]
    return [min(s) for s in shared if s]


def encode_text(c: Codec, text: str, chunk: int, overlap: int) -> list[int]:
    """The ids of one text by its chunks."""
    if len(text) <= chunk:
        return c.encode(text)
    heads, tails = zip(*(scan_chunk(c, t, i, chunk, overlap) for i, t in enumerate(chunks_of(text, chunk, overlap))), strict=True)
    cuts = [0, *stitches(heads, tails), len(text)]
    ids: list[int] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        ids += c.encode(text[a:b])
    return ids


def codec(tokenizer: TokenizerFile, pattern: str) -> Codec:
    begin(_CODECS)
    key = tokenizer.version, pattern
    if key not in _CODECS:
        _CODECS[key] = Codec(tokenizer.load(), pattern)
    return _CODECS[key]


def _row(c: Codec, ids: list[int], with_ids: bool) -> tuple:
    return len(ids), hashlib.sha256(c.ids_text(ids).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest(), ids if with_ids else None


_COLUMNS = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))]


def _short(tokenizer, pattern, chunk, overlap, with_ids):
    def encode(batches):
        c = codec(tokenizer, pattern)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                rows = [_row(c, encode_text(c, t, chunk, overlap), with_ids) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), _COLUMNS, strict=True))], names=["id", *(n for n, _ in _COLUMNS)])

    return encode


def _chunks(chunk, overlap):
    schema = pa.schema([("digest", pa.binary()), ("i", pa.int64()), ("text", pa.string())])

    def cut(batches):
        for digests, texts in rows_of(batches, "digest", "text"):
            for d, text in zip(digests, texts, strict=True):
                for k in range(0, len(text), 64 * chunk):
                    own = [text[j : j + chunk + overlap] for j in range(k, min(k + 64 * chunk, len(text)), chunk)]
                    yield batch(schema, [d] * len(own), range(k // chunk, k // chunk + len(own)), own)

    return cut


def _scan(tokenizer, pattern, chunk, overlap):
    schema = pa.schema([("digest", pa.binary()), ("i", pa.int64()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

    def scan(batches):
        c = codec(tokenizer, pattern)
        for digests, numbers, texts in rows_of(batches, "digest", "i", "text"):
            heads, tails = zip(*(scan_chunk(c, t, i, chunk, overlap) for t, i in zip(texts, numbers, strict=True)), strict=True)
            yield batch(schema, digests, numbers, heads, tails)

    return scan


def _pieces():
    schema = pa.schema([("digest", pa.binary()), ("j", pa.int64()), ("text", pa.string())])

    def cut(batches):
        for digests, texts, cuts in rows_of(batches, "digest", "text", "cuts"):
            for d, text, own in zip(digests, texts, cuts, strict=True):
                ends = [0, *own, len(text)]
                for k in range(0, len(ends) - 1, 64):
                    some = [text[a:b] for a, b in zip(ends[k : k + 64], ends[k + 1 : k + 65], strict=False)]
                    yield batch(schema, [d] * len(some), range(k, k + len(some)), some)

    return cut


def _encode_pieces(tokenizer, pattern):
    schema = pa.schema([("digest", pa.binary()), ("j", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        import numpy as np

        c = codec(tokenizer, pattern)
        for digests, numbers, texts in rows_of(batches, "digest", "j", "text"):
            yield batch(schema, digests, numbers, [np.array(c.encode(t), "<u4").tobytes() for t in texts])

    return encode


def _join_pieces(tokenizer, pattern, with_ids):
    schema = pa.schema([("digest", pa.binary()), *_COLUMNS])

    def join(key, table):
        import numpy as np

        c = codec(tokenizer, pattern)
        pieces = sorted(zip(table["j"].to_pylist(), table["ids"].to_pylist(), strict=True))
        ids = np.frombuffer(b"".join(p for _, p in pieces), "<u4").tolist()
        return pa.Table.from_batches([batch(schema, [key[0].as_py()], *([x] for x in _row(c, ids, with_ids)))])

    return join


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, dealt_chars: int = DEALT_CHARS, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id_col, n_tokens, ids_sha256, decoded_sha256 and, unless
    with_ids is false, ids.

    Ids are those of each match of ``pattern`` under the ranks in ``ranks_path``, without special
    tokens; the digests are of the decimal ids joined by one space and of the bytes that the ids
    decode to. Null texts count as empty (no ids). Null and repeated ids, and repeated rows, give a
    row each; other columns aren't read; an empty table gives no rows. The chunks of a text beyond
    ``dealt_chars`` are dealt over tasks, once for each distinct text, and its ids meet in one row. Where
    neighbouring chunks share no boundary between ASCII characters (say, a script without spaces)
    they form one piece.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("the overlap must be positive and smaller than a chunk")
    spark = docs.sparkSession
    tokenizer = TokenizerFile(spark, ranks_path)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    own = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    out = T.StructType([base.schema["id"], *own])
    one = F.length("text") <= dealt_chars
    result = base.filter(one).mapInArrow(_short(tokenizer, pattern, chunk_chars, overlap_chars, with_ids), out)

    many = base.filter(~one).withColumn("digest", F.unhex(F.sha2("text", 256)))
    texts = stored(many.groupBy("digest").agg(F.first("text").alias("text")), "bpe-long")
    if not texts.isEmpty():
        chunks = texts.mapInArrow(_chunks(chunk_chars, overlap_chars), "digest binary, i long, text string")
        scanned = chunks.repartition("digest", "i").mapInArrow(_scan(tokenizer, pattern, chunk_chars, overlap_chars), "digest binary, i long, head array<long>, tail array<long>")
        before = F.lag("tail").over(Window.partitionBy("digest").orderBy("i"))
        cuts = scanned.withColumn("cut", F.array_min(F.array_intersect(before, "head"))).groupBy("digest").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
        pieces = texts.join(cuts, "digest").mapInArrow(_pieces(), "digest binary, j long, text string")
        encoded = pieces.repartition("digest", "j").mapInArrow(_encode_pieces(tokenizer, pattern), "digest binary, j long, ids binary")
        joined = stored(encoded.groupBy("digest").applyInArrow(_join_pieces(tokenizer, pattern, with_ids), T.StructType([T.StructField("digest", T.BinaryType()), *own])), "bpe-joined")
        ids = stored(many.select("id", "digest"), "bpe-rows")
        result = result.unionByName(join_hot_apart(ids, joined, ["digest"]).select(*out.names))
    result = result.withColumnRenamed("id", id_col)
    return result if with_ids else result.drop("ids")


def decode_ids(rows: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``: the raw bytes of the ids, concatenated (null ids: null). An id that
    the vocabulary lacks is an error."""
    tokenizer = TokenizerFile(rows.sparkSession, ranks_path)

    @F.pandas_udf("binary")
    def decode(ids):
        raw = {i: b for b, i in tokenizer.load().items()}
        return ids.map(lambda x: None if x is None else b"".join(raw[int(i)] for i in x))

    return rows.withColumn(out_col, decode(F.col(f"`{ids_col}`")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
