import random
import re
import zlib
from collections import Counter

import pytest

from loomwright.llm.spelling import near_words, roots, spelling_variants, word_counts


def edit(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, min_length=5, min_count=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    near = {w: sorted((v for v in n if edit(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def rows_of(words_with_counts, start=0):
    return [(start + k, " ".join([w] * c)) for k, (w, c) in enumerate(words_with_counts)]


CASES = rows_of([
    ("aaaaa", 3), ("aaaaaa", 7), ("aaaaaaa", 15), ("aaaab", 6), ("baaaa", 6), ("abcde", 40), ("abcdf", 3), ("abcdg", 3), ("bcdef", 3), ("abcdef", 3),
    ("étéete", 4), ("eteete", 8), ("×÷×÷×", 3), ("Étéete", 4), ("ABCDE", 2), ("x" * 300, 5), ("x" * 299 + "y", 12), ("x" * 301, 3), ("x" * 150 + "z" + "x" * 150, 30),
]) + [(None, None), (None, "null null2null abcde"), (7, ""), (7, "abcde"), (7, "abcde")]


def test_cases(spark):
    docs = spark.createDataFrame([(*r, "w", 1) for r in CASES], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute(CASES)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(w[1] and w[1] != w[2] for w in want), "a chain of forms is among the cases"


@pytest.mark.parametrize("seed,letters,size", [(1, "ab", 7), (2, "abcdefg", 6), (3, "aé", 9)])
def test_random_words(spark, seed, letters, size):
    r = random.Random(seed)
    words = Counter("".join(r.choice(letters) for _ in range(r.randint(3, size))) for _ in range(600))
    rows = rows_of([(w, c * r.choice([1, 2, 5])) for w, c in words.items()])
    got = spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), min_count=2).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, min_count=2), key=repr)


def test_no_rows_and_parts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(empty).collect() == []
    docs = spark.createDataFrame([(1, "words words"), (2, "words swords")], "doc_id long, text string")
    assert [tuple(r) for r in word_counts(docs, min_count=3).collect()] == [("words", 3)]
    words = spark.createDataFrame([("hello", 3), ("hallo", 5), ("hell", 9), ("other", 1)], "word string, n long")
    assert {r.word: (r.n_near, r.form, r.form_n) for r in near_words(words).collect()} == {"hello": (2, "hell", 9), "hallo": (1, "hello", 3), "hell": (1, "hello", 3)}
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(9)], "word string, form string")
    assert {r.root for r in roots(chain).collect()} == {"9"}
    with pytest.raises(ValueError):
        spelling_variants(empty, times=1)
