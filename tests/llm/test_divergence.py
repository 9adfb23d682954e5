import random
import re
from collections import Counter, defaultdict

import pytest

from loomwright.llm.divergence import Divergence, source_divergence


def brute(rows, min_docs=2, smooth=5, top=50):
    docs = [("" if lang is None else lang, "" if source is None else source, [t.encode().lower().decode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, terms in own for t in set(terms))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if t in kept)
        everything = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + smooth) // (sum(c.values()) + smooth * len(kept))
        for a in counts:
            pairs = sorted(((sum(abs(share(counts[a], t) - share(counts[b], t)) for t in kept), b) for b in counts if b != a), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, a, "pair", b, v, k + 1) for k, (v, b) in enumerate(pairs)]
            more = [(share(counts[a], t) - share(everything, t), t) for t in kept if counts[a][t] > 0]
            more = sorted((x for x in more if x[0] > 0), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, a, "term", t, v, k + 1) for k, (v, t) in enumerate(more)]
    return sorted(out)


def table(seed=3, sources=9, n=120):
    r = random.Random(seed)
    words = ["Der", "die", "das", "ÄÖ", "äö", "中文", "\U0001f600", "￿", "x" * 500, *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(r.choice(["de", "fr", None, ""]), r.choice([None, *(f"s{k}" for k in range(sources))]), " ".join(r.choice(words[: r.randint(1, 29)]) for _ in range(r.randint(0, 30)))) for _ in range(n)]
    return rows + rows[:5] + [("xx", "lonely", None), ("xx", "empty", ""), ("xx", "other", "once, only!"), (None, "s1", None)]


@pytest.mark.parametrize("block", [256, 2])
def test_brute_force(spark, block):
    rows = table()
    docs = spark.createDataFrame([(*x, 1, "p", 2) for x in rows], "lang string, source string, text string, zero int, part string, rank int").repartition(3)
    want = brute(rows)
    got = source_divergence(docs, min_docs=2).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == want
    pairs = {(r.lang, r.a, r.b): r.value for r in Divergence(docs, min_docs=2).pairs(block=block).collect()}
    assert pairs == {(lang, a, b): v for lang, a, part, b, v, _ in want if part == "pair" and a < b}


def test_nothing_kept_and_no_rows(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert source_divergence(empty).collect() == []
    two = spark.createDataFrame([("a", "x", "one"), ("a", "y", None), ("b", "z", "one")], "lang string, source string, text string")
    assert sorted(map(tuple, source_divergence(two).collect())) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]
    two = spark.createDataFrame([("a", "x", "one one tie"), ("a", "y", "two"), ("a", "z", "two tie")], "lang string, source string, text string")
    assert sorted((r.source, r.item) for r in source_divergence(two, min_docs=1, top=1).collect() if r.part == "term") == [("x", "one"), ("y", "two"), ("z", "tie")]


def test_counts_beyond_long_products(spark):
    """Shares are exact where scale * count overflows 64 bits."""
    from pyspark.sql import functions as F

    from loomwright.llm.divergence import _price

    n, total = 10**12 + 7, 3 * 10**12 + 11
    got = spark.range(1).select(_price(F.lit(n), F.lit(total), 10**9, 5).alias("p")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // total
