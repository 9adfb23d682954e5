import random
import re
from collections import Counter, defaultdict

import pytest

from loomwright.llm.line_templates import drop_recurring_lines


def brute(rows, depth, min_docs, constant, long_words=50, long_docs=3):
    mask = lambda s: re.sub(r"[^ ]*[0-9][^ ]*", "<*>", re.sub(r"[ \t\r\f\x0b]+", " ", s).strip(" "))
    first, occurs = {}, defaultdict(set)
    for i, t in rows:
        t = t or ""
        if t not in first or (first[t] is None or (i is not None and i < first[t])):
            first[t] = i
        for line in t.split("\n"):
            if mask(line):
                occurs[mask(line)].add(t)
    leaves = defaultdict(set)
    for m in occurs:
        k = m.split(" ")
        leaves[len(k), tuple(k[:depth])].add(m)
    template = {m: m for m in occurs}
    for ms in leaves.values():
        docs = set().union(*(occurs[m] for m in ms))
        if len(docs) >= min_docs and len(ms) > 1:
            cols = list(zip(*(m.split(" ") for m in ms), strict=True))
            fixed = [k for k, c in enumerate(cols) if 2 * max(Counter(c).values()) > len(ms)]
            if len(fixed) >= constant * len(cols):
                for m in ms:
                    template[m] = (len(cols), tuple(m.split(" ")[:depth]), tuple(m.split(" ")[k] for k in fixed))
    where, long = defaultdict(set), {}
    for m, docs in occurs.items():
        where[template[m]] |= docs
        long[template[m]] = len(m.split(" ")) >= long_words
    owner = {k: min(d, key=lambda t: (first[t] is None, first[t] or 0)) for k, d in where.items() if len(d) >= (min(long_docs, min_docs) if long[k] else min_docs)}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 1, 0))
            continue
        kept = [x for x in t.split("\n") if not mask(x) or owner.get(template[mask(x)], t) == t]
        out.append((i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdef", k=3))
    rows = []
    for k in range(160):
        lines = [" ".join(word() for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(0, 6))]
        if k % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), f"Page {k} of  {k + 7} printed by {word()} on the third day")
        if k % 4 == 0:
            lines.append("\tAll rights reserved. ")
        if k % 5 == 0:
            lines.append(f"one two three {word()} five {word()} seven eight nine ten")
        if k % 7 == 0:
            lines += ["", "  "]
        rows.append((k, "\n".join(lines)))
    rows += [(1000, "solo line once\nmore"), (None, None), (1001, None), (1002, "")] + [(k, "copy line of many\nAll rights reserved.") for k in range(2000, 2060)]
    return rows + [rows[3]]


@pytest.mark.parametrize("seed,depth,min_docs,constant,long_words,most", [(1, 3, 10, 0.6, 50, 1000), (2, 1, 5, 0.3, 9, 0), (3, 2, 3, 0.9, 50, 1000), (4, 3, 10, 0.6, 8, 0)])
def test_same_as_brute_force(spark, monkeypatch, seed, depth, min_docs, constant, long_words, most):
    monkeypatch.setattr("loomwright.llm.common.LEAST_HOT", 20 if most == 0 else 200)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, "e", 1) for x in rows], "doc_id long, text string, line string, _doc int").repartition(3)
    got = drop_recurring_lines(docs, depth=depth, min_docs=min_docs, constant=constant, long_words=long_words, most_broadcast=most, counts=("n_lines", "n_dropped"))
    assert got.columns == ["doc_id", "text", "line", "_doc", "n_lines", "n_dropped"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=key) == sorted(brute(rows, depth, min_docs, constant, long_words), key=key)


def test_templates_and_copies(spark):
    rows = corpus(1)
    got = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None}
    assert sum("printed by" in (t or "") for t in got.values()) == 1 and "printed by" in got[0]
    assert all(got[k] == "copy line of many" for k in range(2000, 2060)), "exact copies don't recur; the footer does"
    assert got[1000] == "solo line once\nmore"
    assert drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).collect() == []


def test_long_passages_recur_sooner(spark):
    passage = " ".join(f"word{'abcdefghij'[k % 10]}" for k in range(60))
    rows = [(k, f"own line {'xyzuvwq'[k]}\n{passage}\nshort line") for k in range(4)] + [(9, " ".join(["two"] * 60)), (10, " ".join(["two"] * 60) + "\nelse")]
    got = {r.doc_id: r.text for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [passage in got[k] for k in range(4)] == [True, False, False, False] and all("short line" in got[k] for k in range(4))
    assert got[9] == rows[4][1] and got[10] == rows[5][1], "two documents are too few"
