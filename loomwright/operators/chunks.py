"""Overlapping chunks that end at boundaries. The start of a chunk follows from the end of the one before, so a
text is chunked by one UDF call; texts are spread over tasks."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

SIZE, OVERLAP, LEAST, REACH = 300, 30, 50, 150
TEXT_BYTES, CHUNKS = 1_000_000, 5000  # texts that are Python strings at once, and rows of a batch that is given back
_PARAGRAPH, _SENTENCE, _BODY = re.compile(r"(?=\n\n)"), re.compile(r"[.!?](?=\s)"), re.compile(r"\S(?:.*\S)?", re.S)


class Boundaries:
    """Where chunks of a text may end: all paragraph breaks and sentence ends, found once."""

    def __init__(self, text: str, merge: bool):
        self.text, self.merge = text, merge
        self.breaks = [] if merge else [m.start() for m in _PARAGRAPH.finditer(text)]
        self.stops = [m.end() for m in _SENTENCE.finditer(text)]

    def before(self, start: int, end: int) -> int:
        """The end of a chunk from ``start`` that can go to ``end``: after the last paragraph break that lies wholly
        in its last 150 characters and begins beyond its middle; else after the last sentence end there (one at
        the very end counts, whatever follows); else ``end``. With ``merge`` sentence ends only, which
        must leave a chunk of over 50 characters."""
        low = max(start, end - REACH)
        at = bisect_right(self.breaks, end - 2) - 1
        if at >= 0 and self.breaks[at] >= low and self.breaks[at] - start > (end - start) // 2:
            return self.breaks[at] + 2
        found = end
        if self.text[end - 1] not in ".!?":
            at = bisect_right(self.stops, end - 1) - 1
            if at >= 0 and self.stops[at] > low:
                found = self.stops[at]
        return found if found - start > (LEAST if self.merge else 0) else end


def windows(text: str, size: int, overlap: int, merge: bool, parity: bool):
    """(start, end) of each chunk before trimming. A chunk begins ``overlap`` characters before the end of the one
    before, but later than that one."""
    limits, start, n = Boundaries(text, merge), 0, len(text)
    while start < n:
        end = start + size
        end = limits.before(start, end) if end < n else n
        yield start, end
        if end == n and not parity:
            return
        start = max(end - overlap, start + 1)


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP, merge: bool = False, parity: bool = False) -> list[tuple[int, str, int, int]]:
    """(index, content, start, end) of each chunk; start and end without surrounding white space. ``merge``:
    sentence ends only, and a fragment under 50 characters joins the chunk before and ends the text. ``parity``
    goes on after the end of the text in steps of one character, as the older behaviour did."""
    return list(iter_spans(text, size, overlap, merge, parity))


def iter_spans(text: str, size: int = SIZE, overlap: int = OVERLAP, merge: bool = False, parity: bool = False):
    """``spans``, one after another."""
    last = None
    for body in filter(None, (_BODY.search(text, a, b) for a, b in windows(text, size, overlap, merge, parity))):
        if last and merge and len(body[0]) < LEAST:
            index, content, start, _ = last
            yield index, f"{content} {body[0]}", start, body.end()
            return
        if last:
            yield last
        last = (last[0] + 1 if last else 0, body[0], body.start(), body.end())
    if last:
        yield last


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, merge: bool = False, parity: bool = False) -> DataFrame:
    """A row per chunk: id_col, chunk_index, content, char_start, char_end, char_length. Null and blank texts
    have none."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than a chunk")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        which, rows = [], []

        def given(b):
            cols = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([b.column("id").take(pa.array(which)), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True))], names=["id", "chunk_index", "content", "char_start", "char_end", "char_length"])
            which.clear()
            rows.clear()
            return out

        for whole in batches:
            for b in slices(whole, "text", TEXT_BYTES):
                for k, text in enumerate(b.column("text").to_pylist()):
                    for row in iter_spans(text or "", size, overlap, merge, parity):
                        which.append(k)
                        rows.append((*row, len(row[1])))
                        if len(rows) >= CHUNKS:
                            yield given(b)
                if rows:
                    yield given(b)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, chunk_index int, content string, char_start int, char_end int, char_length int").withColumnRenamed("id", id_col)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.avg("char_length"), F.lit(0.0)).alias("avg_length"))
