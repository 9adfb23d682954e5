"""Spelling variants: words one edit apart, found by merging the subtrees of an errata trie.

The words make a trie, here as a table of its edges. Each node's heaviest child continues its path; every
other child (and a word that ends at the node) is light, so a word has at most log2(words) + 1 light edges. At a
light edge the subtree is merged into its siblings three ways: with its character replaced by the heavy one, with it
skipped, and with the heavy one put before it. What coincides with a word's end, or with another light subtree's
words replaced at the same node, is one edit away. Two words part at one node and one of them takes a light edge
there, so every pair is found, and found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, join_hot_apart, rows_of, stored, text_or_empty

RUN = r"[A-Za-zÀ-ÿ]"
MOST_HELD, SHORT = 300_000, 64
_PRIME, _BASE = (1 << 61) - 1, 1_000_003 * 982_451_653


def _counter(letters: str, min_length: int, drop: int):
    """word and n: the runs of each text, A-Z lower-cased, where crc32 says so less one character."""
    runs_of = re.compile(f"{letters}{{{min_length},}}").findall  # greedy from a run's start, so a match is a whole run

    def drain(counts):
        words = list(counts)
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])
        counts.clear()

    def run(batches):
        begin()
        counts: Counter = Counter()
        for ids, texts in rows_of(batches, "id", "text"):
            for i, text in zip(ids, texts, strict=True):
                start = zlib.crc32(f"{i}:".encode())
                for w, n in Counter(runs_of(text.encode().lower().decode())).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % drop == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < min_length:
                            continue
                    counts[w] += n
                if len(counts) > MOST_HELD:
                    yield from drain(counts)
        yield from drain(counts)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = RUN, min_length: int = 5, min_count: int = 3, drop: int = 97) -> DataFrame:
    """word, n: words of at least ``min_length`` characters that occur ``min_count`` times or more."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).alias("text"))
    counted = rows.mapInArrow(_counter(letters, min_length, drop), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _edges(batches):
    """A row for each edge on a word's path: key, depth, node (a hash of what leads there) and next (the
    character; '' where the word ends)."""
    begin()
    names = ["key", "depth", "node", "next"]

    def out(keys, depths, nodes, nexts):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(depths, pa.int32()), pa.array(nodes, pa.int64()), pa.array(nexts, pa.string())], names=names)

    for keys, words in rows_of(batches, "key", "word"):
        rows = ([], [], [], [])
        for key, word in zip(keys, words, strict=True):
            node = 1
            for depth, c in enumerate(word):
                for column, x in zip(rows, (key, depth, node, c), strict=True):
                    column.append(x)
                node = (node * _BASE + ord(c) + 1) % _PRIME
                if len(rows[0]) >= 50_000:
                    yield out(*rows)
                    rows = ([], [], [], [])
            for column, x in zip(rows, (key, len(word), node, ""), strict=True):
                column.append(x)
        if rows[0]:
            yield out(*rows)


def _key(word: Column) -> Column:
    return F.when(F.length(word) <= SHORT, word).otherwise(F.concat(F.lit("#"), F.sha2(word, 256)))


def errata(words: DataFrame) -> DataFrame:
    """word, n, depth, kind and variant: what merging every light subtree gives. ``replaced``: with the node's heavy
    character for the word's own; ``longer``: with it skipped, so the variant is the shorter word; ``shorter``:
    with the heavy one put in, so it is the longer word. Nodes are told apart by 61-bit hashes; where two share one,
    they share their heavy character too, and the pairs stay the same."""
    words = words.withColumn("key", _key(F.col("word")))
    edges = stored(words.select("key", "word").mapInArrow(_edges, "key string, depth int, node long, next string"), "spelling-edges")
    children = edges.groupBy("node", "next").agg(F.count("*").alias("size"))
    best = F.max(F.when(F.col("next") != "", F.struct("size", (-F.ascii("next")).alias("first"), "next")))
    nodes = children.groupBy("node").agg(F.count("*").alias("children"), best["next"].alias("heavy")).filter("children > 1").select("node", "heavy")
    light = join_hot_apart(edges, stored(nodes, "spelling-nodes"), ["node"]).filter("next != heavy").select("key", "depth", "next", "heavy")
    at = light.join(words, "key")
    before, rest, from_here = F.expr("substring(word, 1, depth)"), F.expr("substring(word, depth + 2)"), F.expr("substring(word, depth + 1)")
    variant = lambda when, kind, text: F.when(when, F.struct(F.lit(kind).alias("kind"), text.alias("variant")))
    inner = F.col("next") != ""
    three = F.array(
        variant(inner, "replaced", F.concat(before, "heavy", rest)),
        variant(inner & (F.substr(rest, F.lit(1), F.lit(1)) != F.col("next")), "longer", F.concat(before, rest)),  # in a row of equal characters the last is skipped
        variant(F.lit(True), "shorter", F.concat(before, "heavy", from_here)),
    )
    return at.select("word", "n", "depth", F.explode(F.array_compact(three)).alias("e")).select("word", "n", "depth", "e.*")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form and form_n: how many words are one edit away, and the one of these that occurs most
    (ties: the first in code-point order). Words without any have no row.

    The words that agree but for one place meet as one group (no larger than the alphabet) and get its size and its
    two best; no pair of them is made. A word's shorter and longer neighbours are joined, at most one for each
    light edge."""
    met = errata(words).join(words.select(F.col("word").alias("variant"), F.col("n").alias("variant_n")), "variant", "left")
    met = stored(met.filter("kind = 'replaced' or variant_n is not null"), "spelling-met")
    other = lambda n, word: F.struct((-F.col(n)).alias("less"), F.col(word).alias("form"))
    pairs = met.filter("kind != 'replaced'").select(F.explode(F.array(F.struct("word", other("variant_n", "variant").alias("best")), F.struct(F.col("variant").alias("word"), other("n", "word").alias("best")))).alias("_")).select("_.word", F.lit(1).alias("near"), "_.best")
    groups = met.filter("kind = 'replaced'").groupBy("variant", "depth").agg(F.collect_list(other("n", "word")).alias("members"), F.first("variant_n").alias("variant_n"))
    heavy = F.when(F.col("variant_n").isNotNull(), F.array(other("variant_n", "variant"))).otherwise(F.array().cast("array<struct<less:bigint,form:string>>"))
    groups = groups.select(F.array_sort(F.concat("members", heavy)).alias("members")).filter("size(members) > 1")
    each = F.transform("members", lambda m, i: F.struct(m["form"].alias("word"), F.when(i == 0, F.col("members")[1]).otherwise(F.col("members")[0]).alias("best")))
    same_length = groups.select(F.explode(each).alias("_"), (F.size("members") - 1).alias("near")).select("_.word", "near", "_.best")
    best = F.min("best")
    return pairs.unionByName(same_length).groupBy("word").agg(F.sum("near").alias("n_near"), best["form"].alias("form"), (-best["less"]).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where the forms of a word (rows of word, form) lead to in the end. Each round doubles the steps."""
    now = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(join_hot_apart(now, on, ["root"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, times: int = 2, **settings) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``docs`` (settings: those of ``word_counts``). A word's
    form is its near word that occurs most, if that occurs ``times`` as often or more; root is where forms lead.

    A null text has no words; a null id counts as ''. Repeated rows count each; an empty table gives no
    rows; other columns, whatever their names, aren't read. Words may be of any length.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their words, or they could go round")
    words = stored(word_counts(docs, **settings), "spelling-words")
    near = stored(near_words(words), "spelling-near")
    linked = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(F.col("form_n") >= times * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")))
    linked = stored(linked, "spelling-forms")
    ends = roots(linked.filter("form is not null"))
    return linked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
crcs AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, bytes, 1), lambda i: ('0x' || hex[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hex, octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM runs), steps),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM crcs) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT DISTINCT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS form, b.n AS form_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, form, form_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY form_n DESC, form) = 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w USING (word) JOIN forms e ON e.word = w.root WHERE e.form IS NULL
"""
