import random
import re
from collections import Counter

import pytest

from loomwright.llm import ngram_join as N


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, families=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    passage = [word() for _ in range(30)]
    rows, i = [], 0
    for f in range(families):
        base = [word() for _ in range(r.randrange(1, 120))]
        if f % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(r.choice([1, 1, 2, 3, 8]) if f else 90):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = word()
            text = " ".join(w)
            rows.append((i, r.choice([text, text.upper(), text.replace(" ", "\n\t ")])))
            i += r.randrange(1, 3)
    rows += [(None, rows[0][1]), (i + 1, None), (i + 2, ""), (i + 3, " \n"), (i + 4, "two words"), (i + 5, "Two  words"), (i + 6, "two"), (i + 7, "ÀB c d e f"), (i + 8, "àB c d e f"), (i + 9, "a b c d e f"), (i + 10, "a\x1cb x y z t")]
    r.shuffle(rows)
    return [*rows, rows[0], rows[5]]


@pytest.mark.parametrize("seed,trie,long,common", [(1, 256, 32, 3), (2, 20, 6, 2), (3, 7, 3, 1000)])
def test_same_as_brute_force(spark, monkeypatch, seed, trie, long, common):
    rows = corpus(seed)
    monkeypatch.setattr("loomwright.llm.common.LEAST_HOT", 5)
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, key string").repartition(3)
    got = N.link_components(docs, trie_sets=trie, long_list=long, locally_common=common, most_broadcast=10**6 if seed == 1 else 0, one_task_edges=10**6 if seed == 1 else 0)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_keep_one_of_each(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(*x, "d", k) for k, x in enumerate(rows)], "doc_id long, text string, doc string, _doc int")
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    groups = brute(rows)
    comps = {c for i, n, c in groups if n}
    got = kept.collect()
    ids = [x.doc_id for x in got if shingles(x.text)]
    assert sorted(ids) == sorted(comps)
    assert sum(not shingles(x.text) for x in got) == sum(not shingles(t) for _, t in rows)
    assert N.keep_one_of_each(docs.limit(0)).collect() == [] == N.link_components(docs.limit(0)).collect()


@pytest.mark.parametrize("seed", range(5))
def test_trie_finds_all_links(seed):
    import numpy as np

    r = random.Random(seed)
    base = [r.sample(range(60), 30) for _ in range(4)]
    sets = [np.array(sorted({*r.sample(b, r.randrange(20, 31)), *r.sample(range(60, 80), r.randrange(0, 6))}), np.uint64) for b in base for _ in range(12)]
    trie = N.Trie(sets, 75, 100)
    for k, s in enumerate(sets):
        found = set()
        trie.walk(s, lambda x: False, found.add)
        assert found == {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))}


def test_a_trie_of_false_candidates_costs_little():
    """sets that met by frequent n-grams but aren't linked share no paths; each asks them all at once."""
    import time

    import numpy as np

    r = np.random.default_rng(2)
    sets = [np.unique(np.r_[r.choice(12, 6), r.choice(4000, 30)]).astype(np.uint64) for _ in range(1500)]
    sets += [s[1:] for s in sets[:40]]
    trie, start, linked = N.Trie(sets, 75, 100), time.perf_counter(), set()
    for k, s in enumerate(sets):
        trie.walk(s, lambda x: x == k, lambda x: linked.add((k, x)))  # noqa: B023
    assert time.perf_counter() - start < 5
    assert linked >= {(k, 1500 + k) for k in range(40)} | {(1500 + k, k) for k in range(40)} and all(100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])) for a, b in linked)


def test_large_sets(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    shared = [[word() for _ in range(60)] for _ in range(6)]
    rows = []
    for f in range(12):
        base = [word() for _ in range(r.randrange(700, 2500))]
        for p in r.sample(shared, 3):
            base[100:100] = p
        for copy in range(r.choice([1, 2, 4])):
            w = list(base)
            for _ in range(r.choice([5, 20, 60]) if copy else 0):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    assert Counter(map(tuple, N.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())) == brute(rows)


def test_longer_prefixes_share_as_many_as_they_must():
    r = random.Random(3)
    for _ in range(300):
        a = set(r.sample(range(6000), r.randrange(600, 3000)))
        b = {x for x in a if r.random() < 0.93} | set(r.sample(range(6000), r.randrange(0, 120)))
        a, b = sorted((sorted(a), sorted(b)), key=len)
        if 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b)):
            first = [set(x[: N.prefix_length(len(x), 75, 100) + int(N.must_share(len(x))) - 1]) for x in (a, b)]
            assert len(first[0] & first[1]) >= int(N.must_share(len(a)))


def test_prefixes_lose_nothing():
    r = random.Random(1)
    for _ in range(3000):
        a = set(r.sample(range(40), r.randrange(1, 30)))
        b = {x for x in a if r.random() < 0.9} | set(r.sample(range(40), r.randrange(0, 5)))
        if b and 100 * len(a & b) >= 75 * len(a | b):
            a, b = sorted((sorted(a), sorted(b)), key=len)
            first = min(set(a) & set(b))
            p, q = a.index(first), b.index(first)
            assert p < N.prefix_length(len(a), 75, 100) and q < N.prefix_length(len(b), 75, 100)
            assert N.may_link(len(a), p, len(b), q, 75, 100)


def test_long_lists_keep_links_between_blocks(spark):
    """The smallest and the largest set of a long list can't be similar to the other block's set, those between can."""
    core = [f"t{k}" for k in range(18)]
    own = lambda name, n: [f"{name}x{k}" for k in range(n)]
    here = [own("small", 3) + core[:16], own("large", 4) + core[:17], *(own(f"m{k}", 2) + core for k in range(6)), *(own(f"f{k}", 1) + core[16:] for k in range(4))]
    rows = [(k, " ".join(w)) for k, w in enumerate([*here, own("y", 2) + core])] + [(k, "") for k in range(13, 24)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")  # y is in the second block
    got = {r.doc_id: r.component_id for r in N.link_components(docs, words=1, long_list=3).collect()}
    assert got == {k: 2 if 2 <= k < 8 or k == 12 else k for k in range(24)}


@pytest.mark.parametrize("partitions,long_list", [(1, 256), (2, 256), (7, 256), (2, 5), (7, 40)])
def test_families_in_several_blocks_are_one(spark, partitions, long_list):
    """Copies that share 86 words of 100 with each other; the shortest and the longest have these words last."""
    base = [f"b{k}" for k in range(94)]
    doc = lambda shared, own, name: " ".join(base[: shared + 4] + [f"{name}r{k}" for k in range(own)])
    rows = []
    for part in range(2):
        texts = [doc(86, 14, f"p{part}x{k}") for k in range(300)] + [doc(82, 16, f"p{part}s"), doc(86, 20, f"p{part}l")]
        texts += [" ".join(base[82:90] + [f"p{part}y{k}f{j}" for j in range(220)]) for k in range(6)]
        rows += [(part * 1000 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.link_components(docs, long_list=long_list).collect()}
    assert {got[p * 1000 + k] for p in range(2) for k in range(300)} == {0}
    assert Counter((i, len(shingles(t)), got[i]) for i, t in rows) == brute(rows)


def _chained(r):
    """Texts of 100 words; each has a run of 8 words that only the next one has too, and one of 8 that three others have.
    The last ten are copies of others but for two words."""
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    runs, hubs = [[word() for _ in range(8)] for _ in range(121)], [[word() for _ in range(8)] for _ in range(30)]
    texts = [runs[k] + [word() for _ in range(38)] + hubs[k // 4] + [word() for _ in range(38)] + runs[k + 1] for k in range(120)]
    texts += [[word(), *w[1:-1], word()] for w in texts[:100:10]]
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


@pytest.mark.parametrize("long_list,longest", [(256, 64), (3, 64), (3, 1)])
def test_sets_with_some_ngrams_in_common_are_no_group(spark, monkeypatch, long_list, longest):
    """Only sets of linked documents go on to be compared whole, unless their list is beyond any that is looked at."""
    needed, stored = [], N.stored

    def watched(df, tag, *rest):
        out = stored(df, tag, *rest)
        needed.extend([out.count()] if tag == "ngram-needed" else [])
        return out

    monkeypatch.setattr(N, "stored", watched)
    monkeypatch.setattr(N, "LONGEST", longest, raising=False)
    rows = _chained(random.Random(4))
    spread = sorted(rows, key=lambda x: x[0] % 4 if x[0] < 120 else (x[0] * 10 + 1) % 4)  # a block has few of a list
    got = N.link_components(spark.createDataFrame(spark.sparkContext.parallelize(spread, 4), "doc_id long, text string"), long_list=long_list)
    assert Counter(map(tuple, got.collect())) == brute(rows)
    assert needed == [20] if longest > 1 else needed[0] > 20


def test_sketches_differ_no_more_than_sets():
    import numpy as np

    r = np.random.default_rng(5)
    draw = lambda n: np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    sets = [draw(int(n)) for n in [1, 2, 100, 128, 129, 300, 900, 5000]]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10 + 1], draw(len(s) // 4 + 1)]) for s in sets]
    sets.sort(key=len)
    of = N.Sketches([N.sketch(s) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    apart = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)])
    found = of.differ(a, b)
    assert (found <= apart).all() and found.max() > 1500
    size = np.array([len(s) for s in sets])
    alike = (size[a] > 50) & (size[a] <= 4096) & (size[a] * 100 >= 75 * size[b]) & (apart > size[a] * 1.5)
    assert alike.any() and (found[alike] > (size[a] + size[b] - 2 * -(-(size[a] + size[b]) * 75 // 175))[alike]).all()
