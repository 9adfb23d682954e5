"""Exact Jaccard self-join of word n-gram sets by prefix trees.

N-grams have one global order: those that are common in some part of the corpus come after all others, by
how common they are, then by hash. A pair of sets that is similar enough shares an n-gram among the
first of each (the prefix that a threshold leaves), so sets meet by the n-grams of their prefixes, and
sizes and positions (what can still be shared) drop most pairs. What is left meets once more with sketches of
the sets (a bit for each value of a few bits of the hashes, set if an odd number of n-grams has it), which differ in
no more bits than the sets do in n-grams: that drops sets that have only some n-grams in common, of which there are
more and more as the corpus grows. Sets that may be linked form groups, and each group's sets go into a trie in the global order, common n-grams first. A place of the trie stands for an
interval of the group's sets, so a set counts its overlap with all sets that share a path at once, by its
n-grams' places alone; sets that are joined to all of a group already don't ask.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import begin, fresh, join_hot_apart, memory, stored, text_or_empty, trim
from .graph import ONE_TASK_EDGES, Forest, components

WORDS, NUM, DEN = 5, 75, 100  # n-gram length; links have DEN * intersection >= NUM * union
LOCALLY_COMMON, MOST_COMMON, BLOCK_NGRAMS = 3, 1_000_000, 4_000_000
LONG_LIST, TRIE_SETS, TRIE_NGRAMS, HUBS, POSTINGS_A_TASK = 256, 2048, 1_000_000, 8, 1_000_000
LONGEST, SKETCHED_A_TASK = 64, 250_000  # lists beyond so many times LONG_LIST are contracted without sketches
LEAST_BITS, MOST_BITS = 128, 4096  # of a sketch
MOST_BROADCAST = 1_000_000  # rows of one hash
LARGE_SET, MORE_SHARED = 600, 12  # sets of so many n-grams must share a twelfth of them in longer prefixes
POSTING = [("h", "<u8"), ("k", "<i8"), ("n", "<u4"), ("p", "<u4")]
STANDS = 2**32 - 1  # in place of a position: the posting stands for a contracted list


class Shingler:
    """Hashes of the distinct n-grams of texts, ascending.

    All texts of a batch are hashed together: a word's hash is a sum of its bytes' values times powers of an
    odd number (mod 2^64), taken from running sums and mixed; an n-gram's hash chains those of its words.
    """

    BATCH_BYTES, BASE = 1_000_000, 0x9E3779B97F4A7C15

    def __init__(self, words: int = WORDS):
        import numpy as np

        self.words = words
        self.value = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        import numpy as np

        if len(self.power) < n:
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 2**64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def batches(self, texts: list[bytes]):
        """(index, set) of each text."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= self.BATCH_BYTES):
                size += len(texts[stop]) + 1
                stop += 1
            yield from zip(range(at, stop), self._sets(texts[at:stop]), strict=True)
            at = stop

    def __call__(self, text: str):
        return next(self.batches([text.encode()]))[1]

    def _sets(self, texts: list[bytes]):
        import numpy as np

        k = self.words
        data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)  # bytes: A-Z only
        self._powers(len(data))
        solid = ~self.space[data]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], dtype=np.uint64, out=run[1:])
        words = _mix((run[ends] - run[starts]) * self.inverse[starts])
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(starts, begins)
        grams = np.full(max(0, len(words) - k + 1), k, np.uint64)
        for j in range(k):
            grams = (grams + words[j : len(words) - k + 1 + j]) * np.uint64(self.BASE)
            grams ^= grams >> np.uint64(29)
        grams = _mix(grams)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                x = np.sort(grams[a : b - k + 1])
            elif b == a:
                x = np.empty(0, np.uint64)
            else:
                x = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    x = (x + words[j]) * np.uint64(self.BASE)
                    x ^= x >> np.uint64(29)
                x = _mix(x)
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x)
        return out


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def set_key(s) -> int:
    """A set's identity: equal sets share it."""
    import xxhash

    x = xxhash.xxh3_64_intdigest(s.tobytes())
    return x - 2**64 if x >= 2**63 else x


def sketch(s) -> bytes:
    """For each value of some bits of the hashes: has an odd number of n-grams it? With at least as many bits as
    n-grams, unrelated sets differ in almost half of them."""
    import numpy as np

    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches by index; longer ones are folded to be compared with shorter ones."""

    def __init__(self, sketches: list[bytes]):
        import numpy as np

        self.size, self.rows = np.array([len(x) for x in sketches], np.int64), {}
        rows, held = None, np.empty(0, np.int64)
        for size in sorted(set(self.size.tolist()), reverse=True):
            while rows is not None and rows.shape[1] * 8 > size:
                half = rows.shape[1] // 2
                rows = rows[:, :half] ^ rows[:, half:]
            own = np.flatnonzero(self.size == size)
            data = np.frombuffer(b"".join(sketches[k] for k in own.tolist()), "<u8").reshape(len(own), -1)
            rows, held = data if rows is None else np.concatenate([rows, data]), np.concatenate([held, own])
            place = np.full(len(sketches), -1, np.int64)
            place[held] = np.arange(len(held))
            self.rows[size] = rows, place

    def differ(self, a, b):
        """At least so many n-grams are in only one of the sets a and b (indices, a's sketches are no longer)."""
        import numpy as np

        out = np.zeros(len(a), np.int64)
        for size, (rows, place) in self.rows.items():
            own = np.flatnonzero(self.size[a] == size)
            for k in range(0, len(own), 50_000):
                i = own[k : k + 50_000]
                out[i] = np.bitwise_count(rows[place[a[i]]] ^ rows[place[b[i]]]).sum(1)
        return out


class Order:
    """The global order of n-grams: how often each was counted among the common ones (0 for all others), then
    by hash."""

    def __init__(self, grams, counts):
        import numpy as np

        self.grams, self.counts = grams, counts
        self.some = np.zeros(1 << 22, bool)  # by leading bits: most n-grams need no search
        self.some[(grams >> np.uint64(42)).astype(np.int64)] = True

    def counted(self, s):
        import numpy as np

        out = np.zeros(len(s), np.int64)
        maybe = np.flatnonzero(self.some[(s >> np.uint64(42)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.grams, s[maybe]), len(self.grams) - 1)
            out[maybe] = np.where(self.grams[at] == s[maybe], self.counts[at], 0)
        return out

    def first(self, s, n: int):
        """The first n of a set given in ascending order."""
        import numpy as np

        counted = self.counted(s)
        rare = s[counted == 0]
        if len(rare) >= n:
            return rare[:n]
        common, counted = s[counted > 0], counted[counted > 0]
        return np.concatenate([rare, common[np.argsort(counted, kind="stable")][: n - len(rare)]])

    def common_first(self, s):
        import numpy as np

        return s[np.argsort(-self.counted(s), kind="stable")]


_ORDERS = memory()


def _order(broadcast) -> Order:
    """The broadcast order, once for each worker."""
    key = id(broadcast.value[0])
    if key not in _ORDERS:
        _ORDERS.clear()
        _ORDERS[key] = Order(*broadcast.value)
    return _ORDERS[key]


def prefix_length(n, num: int, den: int):
    """A set of n that shares num / den of the union with another shares one of its first so many n-grams."""
    return n - (-(-n * num // den)) + 1


def must_share(n):
    """How many n-grams two similar sets, the smaller of n, share in prefixes that are longer by that less one."""
    import numpy as np

    return np.where(n < LARGE_SET, 1, n // MORE_SHARED)


def _describe(words: int, locally_common: int):
    """A row per document (kind 0: id, doc, key, n, sketch) and per locally common n-gram (kind 1: key, n)."""

    def run(batches):
        import numpy as np

        begin(_ORDERS)
        shingle, held, size, seen = Shingler(words), [], 0, set()

        def common():
            grams = np.concatenate(held)
            held.clear()
            grams.sort()
            first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            grams, counts = grams[first], np.diff(np.append(first, len(grams)))
            grams, counts = grams[counts >= locally_common].view(np.int64), counts[counts >= locally_common]
            for k in range(0, len(grams), 50_000):
                own = len(grams[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(own, np.int32)), pa.nulls(own, id_type), pa.nulls(own, pa.int64()), pa.array(grams[k : k + 50_000]), pa.array(counts[k : k + 50_000].astype(np.int64)), pa.nulls(own, pa.binary())], names=["kind", "id", "doc", "key", "n", "sketch"])

        id_type = None
        for whole in batches:
            id_type = whole.column("id").type
            for k in range(0, whole.num_rows, 1000):
                b, keys, sizes, sketches = whole.slice(k, 1000), [], [], []
                for _, s in shingle.batches(b.column("text").to_pylist()):
                    key = set_key(s) if len(s) else 0
                    keys.append(key)
                    sizes.append(len(s))
                    sketches.append(sketch(s) if len(s) else None)
                    if len(s) and key not in seen:
                        seen.add(key)
                        held.append(s)
                        size += len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), b.column("id"), b.column("doc"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["kind", "id", "doc", "key", "n", "sketch"])
                if size > BLOCK_NGRAMS:
                    yield from common()
                    size, seen = 0, set()
        if held:
            yield from common()
        trim()

    return run


def _segments(n, num: int, den: int):
    """Cut ascending sizes into runs in which any two may be similar: the start of each row's run, and whether
    the run's first may be similar to the row before."""
    import numpy as np

    starts, linked = np.empty(len(n), np.int64), np.zeros(len(n), bool)
    at = 0
    while at < len(n):
        stop = int(np.searchsorted(n, n[at] * den // num, "right"))
        starts[at:stop] = at
        linked[at] = at > 0 and n[at - 1] * den >= n[at] * num
        at = stop
    return starts, linked


def _lists(postings):
    """Sort by n-gram, size and set, without repeats (one that stands for a list stays); where each list begins,
    and its length."""
    import numpy as np

    postings = postings[np.lexsort((~postings["p"], postings["k"], postings["n"], postings["h"]))]
    if len(postings):
        postings = postings[np.r_[True, (postings["h"][1:] != postings["h"][:-1]) | (postings["k"][1:] != postings["k"][:-1])]]
    begin = np.flatnonzero(np.r_[True, postings["h"][1:] != postings["h"][:-1]]) if len(postings) else np.empty(0, np.int64)
    return postings, begin, np.diff(np.r_[begin, len(postings)])


def _long_list(own, num, den):
    """Edges that join all of a long list that may be similar, and the postings that stand for it: each run's
    first and last. A set that may by its size be similar to any of a run may be so to one of these two; their
    positions say nothing about the others."""
    starts, linked = _segments(own["n"].astype("i8"), num, den)
    edges = [(int(own["k"][s]), int(own["k"][k])) for k, s in enumerate(starts.tolist()) if k != s]
    edges += [(int(own["k"][k - 1]), int(own["k"][k])) for k in linked.nonzero()[0].tolist()]
    ends = sorted({k for s in set(starts.tolist()) for k in (s, int(starts.searchsorted(s, "right")) - 1)})
    stand = own[ends]
    stand["p"] = STANDS
    return edges, stand


def _send(common, parts: int, num: int, den: int, words: int, long_list: int):
    """The postings of prefixes, in one binary for each block of documents and target part; lists that are
    long within a block are joined here and only their runs' ends sent on."""

    def run(batches):
        import numpy as np

        begin(_ORDERS)
        shingle, order, held, size, seen = Shingler(words), _order(common), [], 0, set()

        def flush():
            postings = np.concatenate(held)
            held.clear()
            postings, starts, length = _lists(postings)
            edges, keep, extra = [], np.ones(len(postings), bool), []
            for at, n in zip(starts[length > long_list].tolist(), length[length > long_list].tolist(), strict=True):
                more, ends = _long_list(postings[at : at + n], num, den)
                edges += more
                keep[at : at + n] = False
                extra.append(ends)
            postings = np.concatenate([postings[keep], *extra])
            part = (postings["h"] % np.uint64(parts)).astype(np.int64)
            by = np.lexsort((postings["k"], part))
            postings, cuts = postings[by], np.searchsorted(part[by], np.arange(parts + 1))
            rows = [(p, b"".join(postings[c][cuts[p] : cuts[p + 1]].tobytes() for c, _ in POSTING), None) for p in range(parts) if cuts[p] < cuts[p + 1]]
            if edges:
                edges = np.unique(np.array(edges, "<i8"), axis=0)
                rows += [(int(p) % parts, None, edges[k : k + 20_000].tobytes()) for p, k in enumerate(range(0, len(edges), 20_000), int(postings["k"][0]) % parts if len(postings) else 0)]
            for k in range(0, len(rows), 64):
                p, data, e = zip(*rows[k : k + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(data, pa.binary()), pa.array(e, pa.binary())], names=["part", "postings", "edges"])

        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                for _, s in shingle.batches(whole.slice(k, 1000).column("text").to_pylist()):
                    if not len(s) or (key := set_key(s)) in seen:
                        continue
                    seen.add(key)
                    own = np.zeros(prefix_length(len(s), num, den) + int(must_share(len(s))) - 1, POSTING)
                    own["h"], own["k"], own["n"], own["p"] = order.first(s, len(own)), key, len(s), np.arange(len(own))
                    held.append(own)
                    size += len(own)
                    if size > POSTINGS_A_TASK:
                        yield from flush()
                        size, seen = 0, set()
        if held:
            yield from flush()
        trim()

    return run


def _edge_batches(pairs):
    for k in range(0, len(pairs), 50_000):
        a, b = zip(*pairs[k : k + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def may_link(n1, p1, n2, p2, num: int, den: int):
    """Of sets of sizes n1 <= n2 whose first common n-gram is at p1 and p2: can they be similar?"""
    need = -(-(n1 + n2) * num // (num + den))
    import numpy as np

    return (n1 * den >= n2 * num) & (p1 <= n1 - (-(-2 * n1 * num // (num + den)))) & (1 + np.minimum(n1 - p1, n2 - p2) - 1 >= need)


def _met(h, key, n, p):
    for k in range(0, len(h), 50_000):
        cols = [pa.array(x[k : k + 50_000].astype("i8")) for x in (h.view("i8"), key, n, p)]
        yield pa.RecordBatch.from_arrays([cols[0], cols[1], pa.nulls(len(cols[0]), pa.int64()), *cols[2:]], names=["h", "a", "b", "n", "p"])


def _meet(num: int, den: int, parts: int, long_list: int, longest: int):
    """One part's postings: those that are in a pair that may be similar (h, a: the set, n, p), and edges (a, b)
    that need no further look, contracted to stars. Pairs that must share more n-grams than there are parts
    share several in at least one part; there they are counted. Postings of longer lists all go on, those of
    lists beyond ``longest`` are joined by size alone."""

    def run(batches):
        import numpy as np

        begin()
        forest, blocks = Forest(), []
        for b in batches:
            for data, edges in zip(b.column("postings").to_pylist(), b.column("edges").to_pylist(), strict=True):
                if edges:
                    for x, y in np.frombuffer(edges, "<i8").reshape(-1, 2).tolist():
                        forest.join(x, y)
                if data:
                    n = len(data) // np.dtype(POSTING).itemsize
                    own, at = np.empty(n, POSTING), 0
                    for c, t in POSTING:
                        own[c] = np.frombuffer(data, t, n, at)
                        at += own[c].nbytes
                    blocks.append(own)
        if blocks:
            postings = np.concatenate(blocks)
            blocks.clear()
            postings, starts, length = _lists(postings)
            for at, n in zip(starts[length > longest].tolist(), length[length > longest].tolist(), strict=True):
                for x, y in _long_list(postings[at : at + n], num, den)[0]:
                    forest.join(x, y)
            length = np.repeat(length, length)
            more = (length > 1) & (length <= longest)
            postings, length = postings[more], length[more]
            h, n, p = postings["h"], postings["n"].astype(np.int64), postings["p"].astype(np.int64)
            key, often, counted, used = postings["k"], -(-must_share(n) // parts), [], length > long_list
            for d in range(1, long_list):
                i = np.flatnonzero((h[d:] == h[:-d]) & ~(used[d:] & used[:-d]))
                if not len(i):
                    break
                i = i[n[i] * den >= n[i + d] * num]
                many = often[i] > 1
                if many.any():
                    m = i[many]
                    counted.append(np.stack([key[m], key[m + d], often[m], m, m + d], 1))
                i = i[~many]
                i = i[_by_place(n, p, i, d, num, den)]
                used[i] = used[i + d] = True
            if counted:
                counted = np.concatenate(counted)
                _, pair, times = np.unique(counted[:, :2], axis=0, return_inverse=True, return_counts=True)
                used[counted[times[pair.ravel()] >= counted[:, 2], 3:]] = True
            yield from _met(h[used], key[used], n[used], p[used])
        for b in _edge_batches(forest.rows()):
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, *b.columns, none, none], names=["h", "a", "b", "n", "p"])
        trim()

    return run


def _by_place(n, p, i, d: int, num: int, den: int):
    """Which of the pairs i and i + d of a list may be linked by their positions; what stands for a list may be."""
    return (p[i] == STANDS) | (p[i + d] == STANDS) | may_link(n[i], p[i], n[i + d], p[i + d], num, den)


def _agree(num: int, den: int, parts: int):
    """Whole lists of postings with sketches (h, key, n, p, sketch): edges between sets that may be similar by size,
    position and sketch, contracted to stars. Sets that are joined already aren't compared again."""

    def run(batches):
        import numpy as np

        begin()
        held, sketches = [], []
        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("h", "key", "n", "p")])
            sketches += b.column("sketch").to_pylist()
        if not sketches:
            return
        h, key, n, p = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        keys, first, own = np.unique(key, return_index=True, return_inverse=True)
        of = Sketches([sketches[k] for k in first.tolist()])
        sketches.clear()
        by = np.lexsort((key, n, h))
        h, n, p, own = h[by], n[by], p[by], own[by]
        cuts = np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)]
        end, often = np.repeat(cuts[1:], np.diff(cuts)), -(-must_share(n) // parts)
        forest, root, i, d, known = Forest(), np.arange(len(keys)), np.arange(len(h)), 0, 0
        while True:
            d += 1
            i = i[i + d < end[i]]
            i = i[n[i] * den >= n[i + d] * num]  # sizes ascend: later ones fit no better
            if not len(i):
                break
            j = i[root[own[i]] != root[own[i + d]]]
            j = j[(often[j] > 1) | _by_place(n, p, j, d, num, den)]
            sure = (p[j] == STANDS) | (p[j + d] == STANDS)
            most = n[j] + n[j + d] - 2 * -(-(n[j] + n[j + d]) * num // (num + den))
            j = j[sure | (of.differ(own[j], own[j + d]) <= most)]
            for x, y in np.unique(np.stack([own[j], own[j + d]], 1), axis=0).tolist():
                forest.join(x, y)
            if d & (d - 1) == 0 and len(forest.up) > known:
                known = len(forest.up)
                for x in list(forest.up):
                    root[x] = forest.root(x)
        yield from _edge_batches([(int(keys[x]), int(keys[y])) for x, y in forest.rows()])
        trim()

    return run


class Trie:
    """A trie of ordered sets, laid out as intervals: with the sets in lexicographic order, those below a place of
    the trie are neighbours, so each n-gram has a list of (first set, set after the last), one for each of its places."""

    def __init__(self, rows, num: int, den: int):
        """rows: (set in trie order) by index."""
        import numpy as np

        self.num, self.den = num, den
        self.order = np.array(sorted(range(len(rows)), key=lambda k: rows[k].astype(">u8").tobytes()), np.int64)
        self.sizes = np.array([len(rows[k]) for k in self.order], np.int64)
        path, last, n = np.empty(int(self.sizes.max(initial=0)), np.int64), np.empty(0, np.uint64), 0
        grams, firsts, ends = [], [], np.full(int(self.sizes.sum()), len(rows), np.int64)
        for j, k in enumerate(self.order.tolist()):
            own = rows[k]
            both = min(len(own), len(last))
            differ = own[:both] != last[:both]
            shared = int(differ.argmax()) if differ.any() else both
            ends[path[shared : len(last)]] = j  # these places end before this set
            path[shared : len(own)] = np.arange(n, n + len(own) - shared)
            grams.append(own[shared:])
            firsts.append(np.full(len(own) - shared, j))
            n, last = n + len(own) - shared, own
        grams, ends = np.concatenate([np.empty(0, np.uint64), *grams]), ends[:n]
        by = np.argsort(grams, kind="stable")
        self.firsts, self.ends = np.concatenate([np.empty(0, np.int64), *firsts])[by], ends[by]
        self.grams, at = np.unique(grams[by], return_index=True)
        self.at = np.append(at, n)

    def linked(self, s_sorted):
        """The sets (by index) that are linked with the set of sorted hashes: each place of the trie that holds one of
        its n-grams counts once for all sets below."""
        import numpy as np

        if not len(s_sorted) or not len(self.grams):
            return np.empty(0, np.int64)
        g = np.minimum(np.searchsorted(self.grams, s_sorted), len(self.grams) - 1)
        g = g[self.grams[g] == s_sorted]
        n = self.at[g + 1] - self.at[g]
        places = np.repeat(self.at[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
        m = len(self.order)
        overlap = np.cumsum(np.bincount(self.firsts[places], minlength=m + 1) - np.bincount(self.ends[places], minlength=m + 1))[:m]
        return self.order[(overlap > 0) & ((self.num + self.den) * overlap >= self.num * (len(s_sorted) + self.sizes))]

    def walk(self, s_sorted, skip, found) -> None:
        """Call found(k) for each set k linked with the set of sorted hashes; skip(k): need not be found."""
        for k in self.linked(s_sorted).tolist():
            if not skip(k):
                found(k)


def _solve(common, num: int, den: int, words: int):
    """Groups of sets, one after another (rows: grp, role, key, label, text): links as edges. Role 1 rows are
    joined with all rows of the group; role 0 rows only with those of role 1. Equal labels are joined already."""

    def run(batches):
        import numpy as np

        begin(_ORDERS)
        order, shingle = _order(common), Shingler(words)

        def solve(rows):
            forest = Forest()
            for _, key, label, _ in rows:
                forest.join(key, label)
            known = dict(forest.up)
            sets, keys = [s for _, s in shingle.batches([r[3] for r in rows])], [r[1] for r in rows]
            trie = Trie([order.common_first(s) for s in sets], num, den)
            root = np.array([forest.root(k) for k in keys], np.int64)
            for k, (role, *_) in enumerate(rows):
                if role and (root != root[k]).any():
                    met = np.unique(np.append(root[trie.linked(sets[k])], root[k]))
                    if len(met) > 1:  # ascending: the first is the new root
                        for x in met[1:].tolist():
                            forest.join(int(met[0]), x)
                        root[np.isin(root, met)] = met[0]
            return [(a, b) for a, b in forest.rows() if known.get(a) != b]

        out, rows, grp = [], {}, None
        for b in batches:
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("grp", "role", "key", "label", "text")), strict=True):
                if g != grp:
                    if len(rows) > 1:
                        out += solve(list(rows.values()))
                    rows, grp = {}, g
                    if len(out) > 50_000:
                        yield from _edge_batches(out)
                        out = []
                if row[1] not in rows or row[0] > rows[row[1]][0]:
                    rows[row[1]] = row
        if len(rows) > 1:
            out += solve(list(rows.values()))
        yield from _edge_batches(out)

    return run


class NgramJoin:
    """The join of one table: ``docs`` has a row per document (id, doc: hash of the text, key: of its set, n) and
    ``roots`` (key, root) the linked sets; sets that aren't in it are alone."""

    def __init__(self, docs: DataFrame, roots: DataFrame):
        self.docs, self.roots = docs, roots

    def labelled(self) -> DataFrame:
        """docs with label: equal for linked documents; documents without words have none."""
        label = F.when(F.col("n") > 0, F.coalesce("root", "key"))
        joined = join_hot_apart(self.docs, self.roots, ["key"], "left").select("id", "doc", "n", label.alias("label"))
        return stored(joined, "ngram-labelled")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, long_list: int = LONG_LIST, trie_sets: int = TRIE_SETS, locally_common: int = LOCALLY_COMMON, most_broadcast: int = MOST_BROADCAST, one_task_edges: int = ONE_TASK_EDGES) -> NgramJoin:
    """Join the n-gram sets of all whole texts; links have den * intersection >= num * union.

    A-Z are lower-cased and words are runs of other than ASCII white space; a text with fewer than ``words``
    words has its whole sequence as its only n-gram; one without words, or null, has none and is linked
    with nothing. N-grams and sets are compared as 64-bit hashes. Equal sets are one set from the start,
    so copies and repeated rows cost nothing; null ids are allowed; an empty table gives an empty join.
    The common n-grams that the order needs (at most a million) are the only thing broadcast; any order
    gives the same links, and so do any ``long_list`` (postings of an n-gram that are held apart),
    ``locally_common`` (how often in a block of documents an n-gram is counted as common), ``most_broadcast``
    (rows of a hash that are broadcast) and ``one_task_edges`` (see ``components``). Groups beyond ``trie_sets``
    sets (or TRIE_NGRAMS n-grams in all) are worked in blocks of that size: each with hubs of the group first, and then only the sets that are
    still apart with the rest.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    described = T.StructType([T.StructField("kind", T.IntegerType()), base.schema["id"], *(T.StructField(c, T.LongType()) for c in ("doc", "key", "n")), T.StructField("sketch", T.BinaryType())])
    raw = base.withColumn("doc", F.xxhash64("text")).withColumn("text", F.col("text").cast("binary"))
    rows = stored(raw.mapInArrow(_describe(words, locally_common), described), "ngram-docs")
    described = rows.filter("kind = 0").select("id", "doc", "key", "n")
    grams = rows.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "key").limit(MOST_COMMON).toArrow()
    import numpy as np

    h, n = grams["key"].to_numpy().view(np.uint64), grams["n"].to_numpy()
    by = np.argsort(h)
    common = spark.sparkContext.broadcast((h[by], n[by]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = described.agg(F.sum(F.col("n") * ((den - num) / den + 1 / MORE_SHARED) + 1)).first()[0] or 0
    parts = max(parts, math.ceil(total / POSTINGS_A_TASK))

    sent = raw.select("text").mapInArrow(_send(common, parts, num, den, words, long_list), "part int, postings binary, edges binary")
    met = stored(sent.repartitionById(parts, F.col("part")).mapInArrow(_meet(num, den, parts, long_list, LONGEST * long_list), "h long, a long, b long, n long, p long"), "ngram-met")
    postings = met.filter("b is null").select("h", F.col("a").alias("key"), "n", "p")
    sketched = postings.join(rows.filter("kind = 0").select("key", "sketch").dropDuplicates(["key"]), "key")
    agree = sketched.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(postings.count() / SKETCHED_A_TASK)), "h").mapInArrow(_agree(num, den, parts), "a long, b long")
    groups = components(met.filter("b is not null").select("a", "b").unionByName(agree), one_task_edges=one_task_edges)
    groups = stored(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "ngram-groups")

    # one text of each candidate
    needed = described.groupBy("key").agg(F.min("doc").alias("doc"), F.max("n").alias("n")).join(groups.select(F.col("node").alias("key"), F.col("root").alias("comp")), "key")
    needed = stored(needed, "ngram-needed")
    large = stored(needed.groupBy("comp").agg(_tries(trie_sets).alias("blocks")).filter("blocks > 1"), "ngram-large")
    few = F.broadcast(needed.select("doc")) if needed.count() <= most_broadcast else needed.select("doc")
    texts = raw.select("doc", "text").join(few, "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text"))
    sets = stored(texts.join(needed, "doc").select("key", "comp", "n", "text"), "ngram-texts")
    solve = lambda x: x.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(_solve(common, num, den, words), "a long, b long")
    shape = lambda x, grp, role: x.select(grp.alias("grp"), F.lit(role).alias("role"), "key", F.col("label"), "text")
    one = lambda x: x.withColumn("label", F.col("key"))
    links = solve(shape(one(sets.join(large, "comp", "left_anti")), F.struct("comp", F.lit(0).alias("x"), F.lit(0).alias("y")).cast("string"), 1))
    roots = links.select(F.col("a").alias("key"), F.col("b").alias("root"))

    if not large.isEmpty():
        roots = roots.unionByName(_large_groups(sets.join(large, "comp", "left_semi"), large, shape, one, solve, trie_sets, one_task_edges))
    return NgramJoin(stored(described, "ngram-described"), stored(roots, "ngram-roots"))


def _tries(trie_sets: int):
    """How many tries of a bounded size the sets (n: their n-grams) need."""
    return F.greatest(F.ceil(F.count("*") / trie_sets), F.ceil(F.sum("n") / TRIE_NGRAMS)).cast("int")


def _large_groups(sets, large, shape, one, solve, trie_sets, one_task_edges) -> DataFrame:
    """Links in groups that are too large for one trie: key, root."""
    block = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")
    members = sets.join(large, "comp").withColumn("block", block)
    rank = Window.partitionBy("comp").orderBy(F.xxhash64("key", F.lit(2)), "key")
    hubs = members.select("comp", "key", "blocks").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= HUBS).join(sets, ["comp", "key"])
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    grp = F.struct("comp", F.col("block").alias("x"), F.lit(-1).alias("y")).cast("string")
    first = shape(one(members), grp, 1).unionByName(shape(one(hubs.withColumn("block", every)), grp, 1))
    links = stored(solve(first), "ngram-links")
    found = components(links, one_task_edges=one_task_edges)
    labels = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(labels.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("label", F.coalesce("root", "key")).drop("root")
    marked = stored(members.select("key", "comp", "n", "label", "block", "blocks"), "ngram-labels")
    most = marked.groupBy("comp", "label").count().groupBy("comp").agg(F.max(F.struct("count", "label")).alias("m")).select("comp", F.col("m.label").alias("main"))
    apart = marked.join(most, "comp").filter("label != main").select("comp", "key", "n", "label", "blocks")
    left = apart.groupBy("comp").agg(_tries(trie_sets).alias("rblocks"))
    apart = apart.drop("n").join(left, "comp").withColumn("rblock", F.pmod(F.xxhash64("key", F.lit(3)), F.col("rblocks")).cast("int")).join(sets, ["comp", "key"])
    grp = F.struct("comp", F.col("rblock").alias("x"), F.col("block").alias("y")).cast("string")
    again = shape(apart.withColumn("block", every), grp, 1).unionByName(shape(marked.drop("n").join(left, "comp").join(sets, ["comp", "key"]).withColumn("rblock", F.explode(F.sequence(F.lit(0), F.col("rblocks") - 1))), grp, 0))
    more = stored(solve(again), "ngram-links")
    return components(links.unionByName(more), one_task_edges=one_task_edges).select(F.col("node").alias("key"), "root")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id (the smallest id reachable by links, itself
    included; null if all of these are null). See ``ngram_join``."""
    found = ngram_join(docs, id_col, text_col, **options).labelled()
    least = stored(found.filter("label is not null").groupBy("label").agg(F.min("id").alias("least")), "ngram-least")
    return join_hot_apart(found, least, ["label"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near copies: of linked documents the one with the
    smallest id stays (null ids last, then the smaller hash of the text; of rows that repeat both, one).
    Documents without words all stay."""
    found = ngram_join(docs, id_col, text_col, **options).labelled().filter("label is not null")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc")
    first = stored(found.groupBy("label").agg(F.min(place).alias("first"), F.count("*").alias("size")).filter("size > 1"), "ngram-first")
    members = join_hot_apart(found, first, ["label"])
    gone = stored(members.filter(~place.eqNullSafe(F.col("first"))).select("id", "doc").distinct(), "ngram-gone")
    again = members.filter(place.eqNullSafe(F.col("first"))).groupBy("id", "doc").count().filter("count > 1").select("id", "doc")
    doc, nth = fresh(docs, "_doc"), fresh(docs, "_nth")
    marked = docs.withColumn(doc, F.xxhash64(text_or_empty(text_col)))
    same = lambda x: (F.col(doc) == x["doc"]) & F.col(f"`{id_col}`").eqNullSafe(x["id"])
    few = F.broadcast(gone) if gone.count() <= MOST_BROADCAST // 2 else gone  # else all texts are shuffled
    kept = marked.join(few, same(gone), "left_anti")
    if not (again := stored(again, "ngram-repeats")).isEmpty():  # rows of one id and text: number those
        repeated = kept.join(again, same(again), "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(doc, f"`{id_col}`").orderBy(F.lit(1)))).filter(F.col(nth) == 1).drop(nth)
        kept = kept.join(again, same(again), "left_anti").unionByName(repeated)
    return kept.select(*[f"`{c}`" for c in docs.columns])


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), both_ways AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
