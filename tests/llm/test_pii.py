import hashlib
import os
import re
import time
from collections import Counter, defaultdict

import pytest

from loomwright.llm.pii import KINDS, base_spans, contexts, luhn, normal, personal_data, unknown_spans

RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text):
    """The base spans by the rules as they are stated."""
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = [c for c in m.group() if c in "0123456789"]
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and luhn("".join(digits))):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def brute(rows, rounds=3, confident=750_000, seeds=3):
    """The method over plain dictionaries."""
    words_of = lambda t: re.findall(r"[^\W\d_]+", normal(t))
    total, edges, places = Counter(), Counter(), []
    for n, (_, text) in enumerate(rows):
        text = text or ""
        low, words = normal(text), words_of(text)
        total.update(words)
        total.update(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        base = plain_base(text)
        for s, e, known, kinds in [(s, e, k, (k,)) for k, s, e in base] + [(s, e, -1, tuple(ks)) for s, e, ks in unknown_spans(text, base)]:
            places.append((n, s, e, known, kinds, contexts(low, s, e)))
            for c in contexts(low, s, e):
                edges[c, low[s:e], known, kinds] += 1
    distinct, trusted, most, slots = Counter(), Counter(), Counter(), Counter()
    for (c, _, known, kinds), w in edges.items():
        slots[c] += w
        for k in kinds:
            most[c, k] += w
        if known >= 0:
            distinct[c, known] += 1
            trusted[c, known] += w
    sizes = {p: max(total[p[0][1]], slots[p[0]]) for p in distinct}
    viable = {p for p in distinct if distinct[p] >= seeds and most[p] * 10**6 >= confident * (sizes[p] + 1)}
    more = Counter()
    for _ in range(rounds):
        score = {p: min(10**6, (trusted[p] * 10**6 + more[p]) // (sizes[p] + 1)) for p in viable}
        of = defaultdict(list)
        for (c, v, known, kinds), w in edges.items():
            if known < 0:
                for k in kinds:
                    if (c, k) in viable:
                        of[v, k].append((score[c, k], (c, k), w))
        more = Counter()
        for met in of.values():
            if len(met) > 1:
                trust = sorted(met, reverse=True, key=lambda x: x[0])[1][0]
                for _, p, w in met:
                    more[p] += w * trust
    found = defaultdict(list)
    for n, s, e, known, kinds, own in places:
        if known < 0:
            best = max(((score[c, k], -k) for c in own for k in kinds if (c, k) in viable and score[c, k] >= confident), default=None)
            if best:
                found[n].append((-best[1], s, e))
    out = []
    for n, (i, text) in enumerate(rows):
        base = plain_base(text or "")
        out.append((i, *(sum(k == j for k, _, _ in base) for j in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + found[n]))))
    return sorted(out, key=repr)


TRICKY = [
    None, "", "a@b.c d@e", "x.@y.z.@w.v", "@a.b@c.d", "a@b.c.@d.e", "é.f@g-h.i_j@k.l", "aa@bb@cc.dd", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 001.002.0003.255 1.2.3.", "0" * 4000 + "1.2.3.4", "9" * 4000 + ".1.1.1",
    "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111111 4", "x4111111111111111x", "5500-0000-0000-0004-", "0000000000000000000", "00000000000000000000", "+1 (017) 555-7713 x", "+1+23456789", "+1 2345678 ..9. (", "+1 (136) 555-4081 190.137.223.204",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "😀 a@b.co 😀 1.1.1.1", "mail: a@b, c@d.e;f@[g]", "a@" * 40, "::1 fe80::1:2 12:30:45 1:2", "(555) 123-4567 555.123.4567", "12.34.56 7.8.9.10.11", "  +44 20 7946 0958  ",
]

#: "dial" and "reach me at" are followed by phones, some of a form that no strict rule takes; "the" by anything.
BOOT = (
    [f"Please dial +49 30 {k}23{k}5{k}7 today" for k in range(1, 9)] + ["please DIAL (030) 555-1234 today", "please dial 030 555 99 17 today", "dial 12 x", "we saw 030 555 99 18 there"]
    + [f"the backup host 10.0.0.{k} replied" for k in range(12)] + ["the backup host fe80::1:9 replied", "the backup host 10.0.1.2.3 replied", "a host 10.9.8 went"]
    + [f"the {k}{k}{k}-{k}{k}{k}{k} of the" for k in range(10)] + [f"write to u{k}@x{k}.org soon" for k in range(5)] + ["write to admin@localhost soon", "Write TO me", "bob@home"]
    + ["card number 4111111111111111 expires"] * 50 + ["card number 4111111111111112 expires"]
)


def test_strict_rules():
    for t in TRICKY + BOOT:
        assert base_spans(t or "") == plain_base(t or ""), t
    for t in TRICKY:
        spans = unknown_spans(t or "", base_spans(t or ""))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_random_texts_keep_to_the_rules():
    import random

    r = random.Random(5)
    for _ in range(4000):
        t = "".join(r.choice("a1@.+-( )0é5") for _ in range(r.randint(0, 60)))
        assert base_spans(t) == plain_base(t), t


def test_long_texts_take_linear_time():
    start = time.perf_counter()
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 100_000, "a@b." * 70_000, "1 " * 150_000, "+1" + "(" * 200_000, "x:" * 100_000):
        unknown_spans(t, base_spans(t))
    assert time.perf_counter() - start < 30


def test_bootstrapping(spark):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(TRICKY + BOOT + BOOT[:3])]
    docs = spark.createDataFrame([(*x, "u", 1) for x in rows], "doc_id long, text string, uid string, base int").repartition(3)
    got = personal_data(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    by_text = {rows[r.row][1]: r.spans for r in personal_data(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "row long, text string"), id_col="row").collect()}
    assert by_text["please DIAL (030) 555-1234 today"] == "phone:13:26" and by_text["the backup host fe80::1:9 replied"] == "ip:16:25"
    assert by_text["write to admin@localhost soon"] == "email:9:24" and by_text["we saw 030 555 99 18 there"] == "" and by_text["bob@home"] == ""
    assert by_text["card number 4111111111111112 expires"] == "", "one card in fifty copies is one seed"


def test_second_contexts_carry_trust(spark):
    """An unknown number beside two good patterns counts for both, from the second round on."""
    rows = [(k, f"call +1 {k}{k}{k} 555 010{k} now") for k in range(4)] + [(10 + k, f"call 0{k}0 555 0199 now") for k in range(1)] + [(20, "call 020 555 0198 later")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 2, 3):
        got = personal_data(docs, rounds=rounds, confident=700_000).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, rounds=rounds, confident=700_000)


def test_no_rows(spark):
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_op13(spark):
    from loomwright.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op13_pii"](spark, "/root/testdata/sf0.001").collect()), key=repr) == brute(rows)
