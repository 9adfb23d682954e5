"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. Each window of W tokens visits every queue that still has tokens
and adds W times the queue's share to its deficit; the queue then gives as many whole tokens as its
deficit holds and carries the rest to the next window. As documents may be cut between any two tokens,
what a queue has given after w windows is the whole part of its credit, so any partition can compute
the deficits at any window from the queues' totals alone: no tokens are sorted, shuffled or replayed,
and every document finds its pieces by itself. An empty queue leaves the round and the others share
its part. Windows follow each other without gaps and are cut into sequences, so that only the last
sequence of all can be short.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import SideFiles, begin, memory, stored, text_or_empty
from .tokenizer_files import TokenizerFile

SEQUENCE, WINDOW_SEQUENCES, MOST_LOCAL = 2048, 64, 1024
TASKS_A_FILE, WINDOWS_A_FILE = 64, 16


class WordEncoder:
    """Ids of texts, item by item from a bounded memory.

    For a tokenizer that lower-cases and drops white space, a text's ids are those of its words (here: cut
    at ASCII white space only) one after another. Words of ASCII and Latin-1 letters are cut into
    pre-tokens over a whole batch at once, by character classes that no version of Unicode changes; any
    other word goes to the library as it is. Items of at most 16 bytes are looked up in a table that
    holds them whole, so equal entries are equal items. Other kinds of tokenizers get whole texts.
    """

    BATCH_BYTES, SLOT_BITS, MOST_IDS, MOST_LONG, SHORT, LONGEST_KEPT = 2_000_000, 20, 4_000_000, 50_000, 16, 64
    SPACE, LETTER, DIGIT, OTHER, ODD = range(5)

    def __init__(self, tokenizer, width: str):
        import json

        import numpy as np

        self.tokenizer, self.width = tokenizer, np.dtype(width)
        config = json.loads(tokenizer.to_str())
        self.pattern = _word_pattern(config)
        if not self.pattern:
            return
        vocabulary = tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith(config["model"]["end_of_word_suffix"])]] = True
        self.special = [t["content"] for t in config["added_tokens"]]
        kind = np.full(256, self.ODD, np.uint8)
        kind[0x21:0x7F] = self.OTHER
        kind[[0x20, *range(0x09, 0x0E)]] = self.SPACE
        kind[0x30:0x3A] = self.DIGIT
        kind[0x41:0x5B] = kind[0x61:0x7B] = self.LETTER
        low = np.arange(256, dtype=np.uint8)
        low[0x41:0x5B] += 32
        self.kind, self.low = kind, low
        # of U+00C0 to U+00FF, by the second byte (the first is C3)
        self.kind2, self.low2 = np.full(256, self.LETTER, np.uint8), np.arange(256, dtype=np.uint8)
        self.kind2[[0x97, 0xB7]] = self.OTHER
        self.low2[0x80:0x9F] += 32
        self.low2[0x97] = 0x97
        self.keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        n = 1 << self.SLOT_BITS
        self.head, self.tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.size, self.count, self.at = np.zeros(n, np.uint8), np.zeros(n, np.int32), np.zeros(n, np.int64)
        self.ids, self.used, self.long = np.empty(1 << 16, self.width), 0, {}

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, texts: list[str]) -> list[bytes]:
        if not self.pattern:
            return self.whole(texts)
        out: list = [None] * len(texts)
        held, size = [], 0
        for k, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[k] = self.whole([t])[0]
                continue
            for piece in _at_spaces(t.encode(), self.BATCH_BYTES):
                held.append((k, piece))
                size += len(piece)
                if size >= self.BATCH_BYTES:
                    self._put(held, out)
                    held, size = [], 0
        self._put(held, out)
        return [b"".join(x) if isinstance(x, list) else x for x in out]

    def _put(self, held, out) -> None:
        if held:
            for (k, _), ids in zip(held, self._batch([b for _, b in held]), strict=True):
                out[k] = ids if out[k] is None else [*(out[k] if isinstance(out[k], list) else [out[k]]), ids]

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        import numpy as np

        low, starts, ends, odd = self._items(texts)
        n = ends - starts
        window = np.lib.stride_tricks.sliding_window_view(low, self.SHORT)[starts].view("<u8")
        head, tail = window[:, 0] & self.keep[np.minimum(n, 8)], window[:, 1] & self.keep[np.clip(n - 8, 0, 8)]
        slot = (head ^ (head >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (tail ^ n.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        slot = (((slot ^ (slot >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        at, count = self.at[slot], self.count[slot]
        known = (self.head[slot] == head) & (self.tail[slot] == tail) & (self.size[slot] == n)
        missing = np.flatnonzero(~known)
        if len(missing):
            short = missing[n[missing] <= self.SHORT]
            if len(short):
                order = short[np.lexsort((n[short], tail[short], head[short]))]
                new = np.r_[True, (head[order[1:]] != head[order[:-1]]) | (tail[order[1:]] != tail[order[:-1]]) | (n[order[1:]] != n[order[:-1]])]
                first = order[new]
                own_at, own_count = self._encode(low, starts[first], ends[first], odd[first])
                self.head[slot[first]], self.tail[slot[first]], self.size[slot[first]] = head[first], tail[first], n[first]
                self.at[slot[first]], self.count[slot[first]] = own_at, own_count
                which = np.cumsum(new) - 1
                at[order], count[order] = own_at[which], own_count[which]
            rest = missing[n[missing] > self.SHORT]
            if len(rest):
                self._long(low, starts, ends, odd, rest, at, count)
        total = np.cumsum(count)
        ids = self.ids[np.arange(total[-1] if len(total) else 0) + np.repeat(at - (total - count), count)]
        bounds = np.r_[0, total][np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))].tolist()
        if self.used > self.MOST_IDS:
            self._forget()
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _items(self, texts: list[bytes]):
        """The lower-cased bytes of all texts, the items' starts and ends in them, and which are odd words."""
        import numpy as np

        raw = np.frombuffer(b"\n".join([*texts, b" " * self.SHORT]), np.uint8)
        kind, low = self.kind[raw], self.low[raw]
        two = np.flatnonzero(raw == 0xC3)
        second = raw[two + 1]
        kind[two] = kind[two + 1] = self.kind2[second]
        low[two + 1] = self.low2[second]
        solid = kind != self.SPACE
        edge = np.r_[True, kind[1:] != kind[:-1]] | (kind == self.DIGIT)
        # 's 't 'm 'd 're 've 'll: where an apostrophe alone comes before them
        mark = np.flatnonzero((raw == 0x27) & edge)
        mark = mark[kind[mark + 1] == self.LETTER]
        x, y = low[mark + 1], low[mark + 2]
        one = (x == 0x73) | (x == 0x74) | (x == 0x6D) | (x == 0x64)
        both = ((x == 0x72) | (x == 0x76)) & (y == 0x65) | (x == 0x6C) & (y == 0x6C)
        edge[mark[one | both] + 1] = False
        edge[mark[one] + 2] = edge[mark[both] + 3] = True
        inside = np.zeros(len(raw), bool)
        strange = np.flatnonzero(kind == self.ODD)
        if len(strange):
            change = np.flatnonzero(solid[1:] != solid[:-1]) + 1
            firsts, lasts = np.r_[0, change][np.r_[solid[0], solid[change]]], np.r_[change, len(raw)][np.r_[solid[0], solid[change]]]
            words = np.unique(np.searchsorted(firsts, strange, "right") - 1)
            step = np.zeros(len(raw) + 1, np.int8)
            step[firsts[words]] += 1
            step[lasts[words]] -= 1
            inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
            edge &= ~inside
            edge[firsts[words]] = edge[lasts[words][lasts[words] < len(raw)]] = True
            low[inside] = raw[inside]
        edge &= solid
        starts = np.flatnonzero(edge)
        ends = np.flatnonzero(solid[:-1] & (edge[1:] | ~solid[1:])) + 1
        return low, starts, ends, inside[starts]

    def _encode(self, low, starts, ends, odd):
        """Where the ids of some items begin in the store of ids, and how many they are."""
        import numpy as np

        data = low.tobytes()
        items = [data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        strange = odd.tolist()
        plain = [x for x, o in zip(items, strange, strict=True) if not o]
        found = iter([ids for k in range(0, len(plain), 500) for ids in self._parts(plain[k : k + 500])])
        others = iter(self.whole([x for x, o in zip(items, strange, strict=True) if o]))
        ids = [next(others if o else found) for o in strange]
        count = np.array([len(x) for x in ids], np.int64) // self.width.itemsize
        at = self.used + np.cumsum(count) - count
        need = self.used + int(count.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(need, self.width)])
        self.ids[self.used : need] = np.frombuffer(b"".join(ids), self.width)
        self.used = need
        return at, count

    def _long(self, low, starts, ends, odd, which, at, count) -> None:
        """Items beyond 16 bytes, one by one; those of moderate length are remembered."""
        import numpy as np

        if len(self.long) > self.MOST_LONG:
            self.long = {}
        seen: dict[bytes, int] = {}
        keys = [low[a:b].tobytes() for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
        for key, k in zip(keys, which.tolist(), strict=True):
            if key not in self.long:
                seen.setdefault(key, k)
        if seen:
            first = np.array(list(seen.values()))
            own_at, own_count = self._encode(low, starts[first], ends[first], odd[first])
            self.long |= {key: (a, c) for key, a, c in zip(seen, own_at.tolist(), own_count.tolist(), strict=True)}
        at[which], count[which] = np.array([self.long[key] for key in keys], np.int64).T
        for key in seen:
            if len(key) > self.LONGEST_KEPT:
                del self.long[key]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens, encoded in one text: each ends with the only id of its that ends a word."""
        import numpy as np

        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.width)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(parts):
            return self.whole(parts)
        size, data, starts = ids.itemsize, ids.tobytes(), [0, *ends[:-1].tolist()]
        return [data[a * size : b * size] for a, b in zip(starts, ends.tolist(), strict=True)]


def _at_spaces(text: bytes, most: int):
    """A text in pieces of about ``most`` bytes, cut only at spaces and line feeds."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(b" ", at, at + most), text.rfind(b"\n", at, at + most))
        if cut <= at:
            cuts = [c for c in (text.find(b" ", at + most), text.find(b"\n", at + most)) if c > 0]
            if not cuts:
                break
            cut = min(cuts)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _word_pattern(config: dict) -> str | None:
    """The pre-token pattern if the tokenizer is of the kind whose words can be encoded one by one: NFC, runs
    of white space to one space, lower case; matches of a pattern without white space; words with an end mark."""
    normal = config.get("normalizer") or {}
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in normal.get("normalizers", [])]
    pre = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    if steps != [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)] or len(pre) != 2 or config.get("post_processor"):
        return None
    split, level = pre
    if split["type"] != "Split" or split["pattern"].get("Regex") != known or split["behavior"] != "Removed" or not split["invert"]:
        return None
    if level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"] or not config["model"].get("end_of_word_suffix"):
        return None
    return known


_ENCODERS = memory()


def _tokenise(tokenizer: TokenizerFile, end_id: int, id_schema: list):
    def run(batches):
        import numpy as np

        begin(_ENCODERS)
        if tokenizer.version not in _ENCODERS:
            t = tokenizer.load()
            _ENCODERS[tokenizer.version] = WordEncoder(t, "<u2" if max(t.get_vocab_size(), end_id + 1) < 65536 else "<u4")
        e = _ENCODERS[tokenizer.version]
        size, end = np.dtype(e.width).itemsize, np.array([end_id], e.width).tobytes()
        given: dict[str, int] = {}  # tokens of each queue so far in this task
        part = TaskContext.get().partitionId()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                own = b.slice(k, 512)
                ids = [x + end for x in e.many(own.column("text").to_pylist())]
                counts, starts = [len(x) // size for x in ids], []
                for queue, n in zip(own.column("queue").to_pylist(), counts, strict=True):
                    starts.append(given.get(queue, 0))
                    given[queue] = starts[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [own.column("id"), own.column("queue"), pa.array([part] * own.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array([size] * own.num_rows, pa.int32()), pa.array(ids, pa.binary())],
                    names=["id", "queue", "part", "start", "n", "width", "ids"],
                )

    return run


class Schedule:
    """What each queue has given after w windows, in closed form.

    totals: tokens of each queue; weights: integer shares (the totals themselves by default, so that all
    queues end together). A phase lasts until a queue ends; there are at most as many as queues.
    """

    def __init__(self, totals: list[int], window: int, weights: list[int] | None = None):
        weights = list(totals) if weights is None else list(weights)
        if any(t and w <= 0 for t, w in zip(totals, weights, strict=True)):
            raise ValueError("a queue with tokens needs a positive weight")
        self.totals, self.window, self.phases, self._at = list(totals), window, [], {}
        given, w = [0] * len(totals), 0
        credit = [(0, 1)] * len(totals)
        while live := [s for s in range(len(totals)) if given[s] < totals[s]]:
            whole = sum(weights[s] for s in live)
            shares = [weights[s] if s in set(live) else 0 for s in range(len(totals))]
            base = [n * whole // d for n, d in credit]  # what is carried, in parts of the new whole
            last = min(-(-(totals[s] * whole - base[s]) // (window * shares[s])) for s in live)
            self.phases.append((w, w + last, whole, shares, base))
            credit = [(base[s] + last * window * shares[s], whole) if shares[s] else (totals[s], 1) for s in range(len(totals))]
            w += last
            given = [min(t, n // d) for t, (n, d) in zip(totals, credit, strict=True)]
            credit = [(t, 1) if g >= t else c for t, g, c in zip(totals, given, credit, strict=True)]
        self.windows = w

    def phase(self, w: int):
        return next((p for p in self.phases if w < p[1]), self.phases[-1])

    def given(self, w: int) -> list[int]:
        if w not in self._at:
            if len(self._at) > 256:
                self._at.clear()
            start, end, whole, shares, base = self.phase(w)
            k = min(w, end) - start
            self._at[w] = [min(t, (b + k * self.window * x) // whole) if x else t for t, x, b in zip(self.totals, shares, base, strict=True)]
        return self._at[w]

    def window_of(self, queue: int, position: int) -> int:
        """The window in which the queue gives the token at ``position`` of its stream."""
        for start, end, whole, shares, base in self.phases:
            if shares[queue] and (end == self.windows or min(self.totals[queue], (base[queue] + (end - start) * self.window * shares[queue]) // whole) > position):
                # the least k with (base + k * window * share) // whole > position, less one
                k = -(-((position + 1) * whole - base[queue]) // (self.window * shares[queue])) - 1
                return start + min(max(k, 0), end - start - 1)
        raise ValueError("no such position")

    def pieces(self, queue: int, start: int, n: int, sequence: int):
        """(offset in the document, length, position in the order of all tokens) of each piece."""
        at, end = start, start + n
        w = self.window_of(queue, at)
        while at < end:
            now, then = self.given(w), self.given(w + 1)
            if then[queue] > at:
                before = sum(now) + sum(then[s] - now[s] for s in range(queue)) - now[queue]
                stop = min(end, then[queue])
                while at < stop:
                    place = before + at
                    length = min(stop - at, sequence - place % sequence)
                    yield at - start, length, place
                    at += length
            w += 1


class _Table:
    """Rows of side files by their first two columns, a key and a queue."""

    def __init__(self, files: SideFiles):
        self.files, self.held = files, (None, {})

    def __call__(self, key: int, queue: str) -> tuple:
        columns = self.files.columns(key)
        if self.held[0] is not columns:
            self.held = columns, {x[:2]: x[2:] for x in zip(*columns, strict=True)}
        return self.held[1][key, queue]


def _cut(schedule: Schedule, begins: SideFiles, queues: dict[str, int], sequence: int, with_ids: bool):
    def run(batches):
        import numpy as np

        of = _Table(begins)
        for b in batches:
            rows, which = [], []
            cols = [b.column(k).to_pylist() for k in ("part", "queue", "start", "n", "width", "ids")]
            for r, (part, queue, at, n, width, ids) in enumerate(zip(*cols, strict=True)):
                at += of(part, queue)[0]
                ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
                for start, length, place in schedule.pieces(queues[queue], at, n, sequence):
                    own = ids[start : start + length]
                    which.append(r)
                    rows.append((start, length, zlib.crc32(own.tobytes()), n, place // sequence, place % sequence, own.astype("i4") if with_ids else None))
            if rows:
                yield _pieces(b, which, rows)

    return run


def _by_window(begins: SideFiles, window: int, whole: int):
    """The pieces that each window takes of a document, when all queues end together."""

    def run(batches):
        find = _Table(begins)
        for b in batches:
            rows, which = [], []
            for r, (part, queue, at, n, width, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "queue", "start", "n", "width", "ids")), strict=True)):
                first, total = find(part, queue)
                at += first
                position, end = at, at + n
                w = -(-(at + 1) * whole // (window * total)) - 1
                while position < end:
                    now, then = min(total, w * window * total // whole), min(total, (w + 1) * window * total // whole)
                    if then > position:
                        stop = min(end, then)
                        which.append(r)
                        rows.append((position - at, stop - position, n, w, position - now, width, ids[(position - at) * width : (stop - at) * width]))
                        position = stop
                    w += 1
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 5 + (pa.int32(), pa.binary()), strict=True)]
                of = pa.array(which)
                yield pa.RecordBatch.from_arrays([b.column("id").take(of), b.column("queue").take(of), *cols], names=["id", "queue", "start", "length", "n", "w", "within", "width", "ids"])

    return run


def _lay(starts: SideFiles, sequence: int, with_ids: bool):
    """Windows' pieces, cut at the ends of sequences."""

    def run(batches):
        import numpy as np

        find = _Table(starts)
        for b in batches:
            rows, which = [], []
            for r, (w, queue, start, length, n, within, width, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("w", "queue", "start", "length", "n", "within", "width", "ids")), strict=True)):
                place = find(w, queue)[0] + within
                ids, at = np.frombuffer(ids, f"<u{width}").astype("<u4"), 0
                while at < length:
                    size = min(length - at, sequence - (place + at) % sequence)
                    own = ids[at : at + size]
                    which.append(r)
                    rows.append((start + at, size, zlib.crc32(own.tobytes()), n, (place + at) // sequence, (place + at) % sequence, own.astype("i4") if with_ids else None))
                    at += size
            if rows:
                yield _pieces(b, which, rows)

    return run


def _pieces(b, which, rows) -> pa.RecordBatch:
    start, length, crc, n, seq, off, own = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [b.column("id").take(pa.array(which)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n, seq, off)), pa.array(own, pa.list_(pa.int32()))],
        names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def _window_starts(taken: DataFrame) -> DataFrame:
    """w, queue, begin (in the order of all tokens) from w, queue and n: sums within a window, within blocks of
    4096 windows and over the blocks."""
    before = lambda n, by, *order: F.coalesce(F.sum(n).over(W.Window.partitionBy(*by).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    inner = taken.select("w", "queue", before("n", ["w"], "queue").alias("inner"))
    windows = taken.groupBy("w").agg(F.sum("n").alias("n")).withColumn("block", F.expr("w div 4096"))
    blocks = windows.groupBy("block").agg(F.sum("n").alias("n")).select("block", before("n", [F.lit(0)], "block").alias("outer"))
    middle = windows.select("w", "block", before("n", ["block"], "w").alias("middle")).join(blocks, "block")
    return inner.join(middle, "w").select("w", "queue", (F.col("inner") + F.col("middle") + F.col("outer")).alias("begin"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shares: dict[str, float] | None = None, most_local: int = MOST_LOCAL, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: id_col, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, unless with_ids is false, ids.

    A document's ids are those of its whole text, then ``end_id``; null texts count as empty. Every source is
    a queue, null sources are one too. The target shares are the sources' own parts of all tokens, or
    ``shares`` by source: then all sources that it doesn't name are one queue with the least share given.
    Null and repeated ids and repeated rows are documents of their own; other columns aren't read; an empty
    table gives no rows. Tokens are stored once in the shared folder. With up to ``most_local`` queues every
    task works out the windows from the queues' totals; with more, grouped sums by window and queue give
    the same places.
    """
    spark = docs.sparkSession
    tokenizer = TokenizerFile(spark, tokenizer_path)
    queue = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n"))
    if shares:
        queue = F.when(queue.isin(["n" if k is None else f"s{k}" for k in shares]), queue).otherwise("others")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"), queue.alias("queue"))
    id_field = base.schema["id"]
    out = T.StructType([id_field, base.schema["queue"], *(T.StructField(n, t()) for n, t in (("part", T.IntegerType), ("start", T.LongType), ("n", T.LongType), ("width", T.IntegerType), ("ids", T.BinaryType)))])
    tokens = stored(base.mapInArrow(_tokenise(tokenizer, end_id, id_field), out), "packing-tokens")

    # where each task's part of a queue begins: a running sum over tasks, for each queue
    by_part = stored(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "packing-parts")
    over = W.Window.partitionBy("queue").orderBy("part")
    total = F.sum("n").over(W.Window.partitionBy("queue"))
    begins = by_part.select("part", "queue", F.coalesce(F.sum("n").over(over.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"), total.alias("total"))
    begins = SideFiles(begins, "part", TASKS_A_FILE, "packing-begins")  # tokens stay where they are, and their tasks look this up
    piece = T.StructType([id_field, *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    totals = by_part.groupBy("queue").agg(F.sum("n").alias("n"))
    window = sequence * window_sequences
    if shares or totals.limit(most_local + 1).count() <= most_local:
        found = sorted(map(tuple, totals.collect()))  # at most most_local rows, or one more than the caller's shares
        weights = None
        if shares:
            least = min(shares.values())
            given = {"n" if k is None else f"s{k}": x for k, x in shares.items()}
            weights = [max(1, round(1e9 * given.get(q, least))) for q, _ in found]
        schedule = Schedule([n for _, n in found], window, weights)
        result = tokens.mapInArrow(_cut(schedule, begins, {q: k for k, (q, _) in enumerate(found)}, sequence, with_ids), piece)
    else:
        whole = totals.agg(F.sum("n")).first()[0]
        taken = T.StructType([id_field, base.schema["queue"], *(T.StructField(n, T.LongType()) for n in ("start", "length", "n", "w", "within")), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())])
        parts = stored(tokens.mapInArrow(_by_window(begins, window, whole), taken), "packing-windows")
        starts = _window_starts(parts.groupBy("w", "queue").agg(F.sum("length").alias("n")))
        result = parts.mapInArrow(_lay(SideFiles(starts, "w", WINDOWS_A_FILE, "packing-starts"), sequence, with_ids), piece)
    result = result.withColumnRenamed("id", id_col)
    return result if with_ids else result.drop("ids")


def sequences(pieces: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The packed sequences of ``pack``'s pieces: sequence_id, ids, n_tokens (before padding). A sequence
    is padded to ``sequence`` ids unless its length is a power of two."""
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
    n = F.size("ids")
    whole = n.bitwiseAND(n - 1) == 0
    return joined.select("sequence_id", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.lit(sequence) - n)))).alias("ids"), n.alias("n_tokens"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
