import random
import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from loomwright.llm.packing import Schedule, WordEncoder, pack, sequences  # noqa: E402

WORDS = P.path("word_bpe_49k.json")


def replay(totals, window, weights):
    """Deficit round-robin, one window after another."""
    from fractions import Fraction

    given, deficit, out = [0] * len(totals), [Fraction(0)] * len(totals), [[0] * len(totals)]
    while any(g < t for g, t in zip(given, totals, strict=True)):
        live = [s for s in range(len(totals)) if given[s] < totals[s]]
        for s in live:
            deficit[s] += Fraction(window * weights[s], sum(weights[x] for x in live))
            n = min(int(deficit[s]), totals[s] - given[s])
            given[s] += n
            deficit[s] -= n
        out.append(list(given))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_closed_form_is_the_round_robin(seed):
    r = random.Random(seed)
    totals = [r.randrange(0, 4000) for _ in range(r.randrange(1, 7))]
    weights = [max(t, 1) for t in totals] if seed % 2 else [r.randrange(1, 50) for _ in totals]
    s = Schedule(totals, 97, weights)
    want = replay(totals, 97, weights)
    assert s.windows == len(want) - 1
    off = max(abs(a - b) for w, row in enumerate(want) for a, b in zip(s.given(w), row, strict=True))
    assert off <= (1 if seed % 2 == 0 else 0), "what is carried over a phase's end is rounded to parts of a token"
    seen = np.zeros(sum(totals), int)
    for q, t in enumerate(totals):
        at = 0
        while at < t:
            n = min(r.randrange(1, 300), t - at)
            got = list(s.pieces(q, at, n, 64))
            assert sum(x[1] for x in got) == n and [x[0] for x in got] == [sum(y[1] for y in got[:k]) for k in range(len(got))]
            for _, length, place in got:
                assert place // 64 == (place + length - 1) // 64
                seen[place : place + length] += 1
            at += n
    assert (seen == 1).all()


def test_pieces(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    r = random.Random(3)
    texts = ["", None, "Hello, WORLD it's 12!", "x<|endoftext|>y <|startoftext|>", "é É ΣΑΣ İ  a\x1cb  c d　e\x0bf́ g", "中文 字😀", "\x00 ​"]
    texts += [" ".join(r.choices(["alpha", "Beta", "gamma!", "12", "zzzq"], k=r.randrange(0, 900))) for _ in range(60)] + ["same text"] * 30
    rows = [(k // 2 if k != 3 else None, x, [None, "a", "a", "b"][k % 4], 1) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3)
    pieces = pack(docs, WORDS, window_sequences=2)
    got = pieces.collect()
    want = sorted((tuple(t.encode(x or "", add_special_tokens=False).ids) + (1,) for x in texts))
    total = sum(map(len, want))
    assert sum(p.length for p in got) == total == max(p.sequence_id * 2048 + p.offset + p.length for p in got)
    assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length for p in got)
    seqs = defaultdict(list)
    for p in got:
        seqs[p.sequence_id].append((p.offset, p.length))
    for x in seqs.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(x))
    # pieces of one document, put together again
    docs_again = defaultdict(list)
    for p in got:
        docs_again[(p.doc_id, p.doc_tokens)].append(p)
    flat = sorted(i for ps in docs_again.values() for p in ps for i in p.ids)
    assert flat == sorted(i for w in want for i in w)
    single = {p.doc_id: tuple(p.ids) for p in got if p.start == 0 and p.length == p.doc_tokens}
    assert single[None] == tuple(t.encode(texts[3], add_special_tokens=False).ids) + (1,)
    packed = sequences(pieces).collect()
    assert sum(s.n_tokens for s in packed) == total and all(len(s.ids) == 2048 or len(s.ids) & (len(s.ids) - 1) == 0 for s in packed)
    assert pack(docs.limit(0), WORDS).collect() == []


def test_windows_hold_the_mixture(spark):
    rows = [(k, "word " * 50, "hot" if k % 3 else f"s{k % 5}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    source = {k: s for k, _, s in rows}
    got = pack(docs, WORDS, sequence=256, window_sequences=4).collect()
    total = sum(p.length for p in got)
    share = defaultdict(float)
    for p in got:
        share[source[p.doc_id]] += p.length / total
    fill = defaultdict(lambda: defaultdict(int))
    for p in got:
        fill[p.sequence_id // 4][source[p.doc_id]] += p.length
    for w in sorted(fill)[:-1]:
        assert all(abs(n - 1024 * share[s]) < 8 for s, n in fill[w].items())


def test_given_shares(spark):
    docs = spark.createDataFrame([(k, "word " * 20, "ab"[k % 2]) for k in range(100)], "doc_id long, text string, source string")
    got = pack(docs, WORDS, sequence=64, window_sequences=2, shares={"a": 0.75, "b": 0.25}).collect()
    first = [p for p in got if p.sequence_id < 10]
    assert abs(sum(p.length for p in first if p.doc_id % 2 == 0) / sum(p.length for p in first) - 0.75) < 0.02
    # sources that aren't named are one queue with the least share
    more = spark.createDataFrame([(k, "word " * 20, ["a", "b", "c", None][k % 4]) for k in range(200)], "doc_id long, text string, source string")
    got = pack(more, WORDS, sequence=64, window_sequences=2, shares={"a": 0.6, "b": 0.2}).collect()
    first = [p for p in got if p.sequence_id < 10]
    for of, share in (({0}, 0.6), ({1}, 0.2), ({2, 3}, 0.2)):
        assert abs(sum(p.length for p in first if p.doc_id % 4 in of) / sum(p.length for p in first) - share) < 0.02


@pytest.mark.parametrize("partitions", [1, 5])
def test_many_sources_are_placed_alike(spark, partitions):
    r = random.Random(5)
    rows = [(k, "word " * r.randrange(0, 60), None if k % 11 == 0 else f"s{min(k % 40, r.randrange(40))}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)
    local, table = (sorted(map(tuple, pack(docs, WORDS, sequence=64, window_sequences=3, most_local=n).drop("ids").collect())) for n in (1000, 7))
    where = lambda rows: sorted((sequence_id, offset, length) for _, _, length, _, _, sequence_id, offset in rows)
    assert where(local) == where(table)
    assert local == table


def test_symbols_beside_every_code_point_as_library():
    """The library's classes count, whatever version of Unicode it has."""
    from tokenizers import Tokenizer

    e = WordEncoder(Tokenizer.from_file(WORDS), "<u2")
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for symbol in ("a", "'", "\u20f5", "\u27e2"):
        for k in range(0, len(points), 100_000):
            texts = [" ".join(symbol + c + symbol for c in points[j : j + 50]) for j in range(k, min(k + 100_000, len(points)), 50)]
            assert e.many(texts) == e.whole(texts)


def test_contractions_and_long_words_as_library():
    from tokenizers import Tokenizer

    e = WordEncoder(Tokenizer.from_file(WORDS), "<u2")
    e.BATCH_BYTES, e.MOST_IDS, e.MOST_LONG = 300, 500, 5
    r = random.Random(1)
    few = list("'" * 4 + " sstrevlmdSTRVLEa b1,.-é×ß")
    all_ = [chr(c) for c in range(0x250)] + ["\u0301", "中", "ж", "Σ", "İ", "K"]
    texts = ["".join(r.choices(few if k % 2 else all_, k=r.randrange(0, 60))) for k in range(3000)]
    texts += ["x" * 40 + " " + "ab" * r.randrange(1, 60) + " 中" + "文" * r.randrange(1, 30) for _ in range(50)] + ["no-space" * 200, " " * 700, ""]
    assert [x for k in range(0, len(texts), 64) for x in e.many(texts[k : k + 64])] == e.whole(texts)


@pytest.mark.parametrize("most_local", [1000, 3])
def test_ids_are_never_shuffled(spark, most_local):
    """Whatever the number of tasks and sources: what a task must know lies in files by task (and by window)."""
    docs = spark.createDataFrame([(k, f"word {k} " * (k % 9), f"s{k % 8}") for k in range(150)], "doc_id long, text string, source string").repartition(5)
    plan = pack(docs, WORDS, sequence=64, window_sequences=3, most_local=most_local)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_side_files(spark):
    from loomwright.llm.common import SideFiles

    rows = [(k // 3, f"q{k % 3}", k) for k in range(300)]
    files = SideFiles(spark.createDataFrame(rows, "part int, queue string, n long").repartition(7), "part", 8, "side")
    files.KEPT = 2
    for key in (0, 7, 8, 99, 0, 50):
        at = files.columns(key)
        assert sorted(x for x in zip(*at, strict=True) if x[0] == key) == [r for r in rows if r[0] == key]
