"""Source divergence audit: how far the sources of a language lie apart, by inclusion and exclusion over supports.

Every source of a language has a smoothed share for each kept term. The distance of two sources is a sum over all
kept terms, but almost all of these occur in one of the two or in neither. So a histogram of each source's counts
prices its terms as if the other lacked them, a constant prices the terms as if both lacked them, and only
the terms that both have are joined, to correct what these two counted wrongly.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import begin, join_hot_apart, rows_of, stored, text_or_empty

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MOST_HELD = 300_000  # terms that a task counts before it passes the counts on
SALTS, BLOCK = 64, 256
_ROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counter(pattern: str):
    """lang, source, term, n and docs (how many rows have the term), summed over as many rows as MOST_HELD allows."""
    terms_of = re.compile(pattern).findall

    def drain(counts, docs):
        for (lang, source), own in counts.items():
            terms, seen = list(own), docs[lang, source]
            for k in range(0, len(terms), 50_000):
                part = terms[k : k + 50_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part), pa.array([own[t] for t in part], pa.int64()), pa.array([seen[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=_ROW)
        counts.clear()
        docs.clear()

    def run(batches):
        begin()
        counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0
        for langs, sources, texts in rows_of(batches, "lang", "source", "text"):
            for lang, source, text in zip(langs, sources, texts, strict=True):
                terms = terms_of(text.encode().lower().decode())  # bytes.lower() changes A-Z alone
                own = counts[lang, source]
                held -= len(own)
                own.update(terms)
                held += len(own)
                docs[lang, source].update(set(terms))
                if held > MOST_HELD:
                    yield from drain(counts, docs)
                    held = 0
        yield from drain(counts, docs)

    return run


def _price(n: Column, total: Column, scale: int, smooth: int) -> Column:
    """1 + floor(scale * (n + smooth) / total), in decimals; 0 where total is 0."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    whole = F.call_function("div", wide(F.lit(scale), 12) * wide(n + smooth, 19), wide(F.nullif(total, F.lit(0)), 20))
    return F.coalesce(1 + whole, F.lit(0).cast("long"))


class Divergence:
    """The audit's tables: ``groups`` (lang, source, total, support, lang_total, terms, zero: the share of a
    term that it lacks) and ``postings`` (one row for each kept term that a group has, with its share p and its
    language's q)."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", pattern: str = TERM, min_docs: int = 30, smooth: int = 5, scale: int = 1_000_000_000):
        rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
        counted = rows.mapInArrow(_counter(pattern), "lang string, source string, term string, n long, docs long")
        # tasks have combined their own counts; one shuffle by language and term serves both sums
        summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        term = Window.partitionBy("lang", "term")
        kept = summed.select("*", F.row_number().over(term.orderBy("source")).alias("place"), F.sum("docs").over(term).alias("all_docs"), F.sum("n").over(term).alias("lang_n"))
        kept = stored(kept.filter(F.col("all_docs") >= min_docs).drop("docs", "all_docs"), "divergence-kept")
        sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
        langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("place") == 1).alias("terms"))
        groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(F.broadcast(langs), "lang", "left")  # a row for each language
        groups = groups.fillna(0, ["total", "support", "lang_total", "terms"])
        self.groups = stored(groups.withColumn("zero", _price(F.lit(0), F.col("total") + smooth * F.col("terms"), scale, smooth)), "divergence-groups")
        priced = join_hot_apart(kept, self.groups, ["lang", "source"])
        p = _price(F.col("n"), F.col("total") + smooth * F.col("terms"), scale, smooth)
        q = _price(F.col("lang_n"), F.col("lang_total") + smooth * F.col("terms"), scale, smooth)
        self.postings = stored(priced.select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), "zero"), "divergence-postings")

    def _salted(self, left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
        """left joined with all rows of right in its language, by a salt that ``left`` draws from ``on`` and that
        right (the groups) is repeated for, so that no task gets a whole language."""
        left = left.withColumn("salt", F.pmod(F.xxhash64(on), F.lit(SALTS)).cast("int"))
        return left.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"])

    def pairs(self, block: int = BLOCK) -> DataFrame:
        """lang, a, b (a < b) and value, the sum of |share in a - share in b| over all kept terms of the language."""
        other = self.groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.col("support").alias("other_support"))
        a, b = F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")
        # terms that both lack, as if no term were in either: each support is taken off once
        both_lack = (F.col("terms") - F.col("support") - F.col("other_support")) * F.abs(F.col("zero") - F.col("other_zero"))
        constants = self._salted(self.groups, other, F.col("source")).filter("source < other").select("lang", a, b, both_lack.alias("value"))
        # terms of one as if the other lacked them: a price for each count that occurs
        counts = self.postings.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("m"))
        one_sided = self._salted(counts, other, F.struct("source", "n")).filter("source != other").select("lang", a, b, (F.col("m") * F.abs(F.col("p") - F.col("other_zero"))).alias("value"))
        # terms of both: what they add, less what the two parts above counted for them
        most = self.groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
        blocks = -(-most // block)  # a term's sources meet in blocks, so no key has more than about block * block pairs
        own = self.postings.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")) if blocks > 1 else self.postings.withColumn("block", F.lit(0))
        left = own.select("lang", "term", "source", "p", "zero", F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"))
        right = own.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
        gap = lambda x, y: F.abs(F.col(x) - F.col(y))
        wrong = gap("p", "other_p") - gap("p", "other_zero") - gap("other_p", "zero") + gap("zero", "other_zero")
        overlaps = left.join(right, ["lang", "term", "i", "j"]).filter("i < j or source < other").select("lang", a, b, wrong.alias("value"))
        parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (constants, one_sided, overlaps)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    def terms(self) -> DataFrame:
        """lang, source, item and value: the terms that a source uses more than its language, and by how much."""
        return self.postings.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, top: int = 50, **settings) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: for each source all others of its language, by falling
    distance; part ``term``: the ``top`` terms that it uses most beyond its language. Ties go by item.

    Null texts, languages and sources count as ''. Every language and source that occurs is a group, also with no
    text or kept term; where a language keeps no term, its distances are 0. Repeated rows count each; an
    empty table gives no rows; other columns, whatever their names, aren't read. All sums are exact integers.
    """
    audit = Divergence(docs, **settings)
    pairs = audit.pairs().select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_"), "value").select("lang", "_.source", "_.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda part, rows: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked("pair", pairs).unionByName(ranked("term", audit.terms()).filter(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)),
totals AS (SELECT lang, source, sum(n) AS t FROM dense GROUP BY ALL),
shares AS (SELECT d.lang, d.source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (t + 5 * v)::HUGEINT AS p FROM dense d JOIN totals USING (lang, source) JOIN size USING (lang)),
lang_n AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS t FROM counts GROUP BY lang, term),
lang_share AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5)::HUGEINT // (t + 5 * v)::HUGEINT AS q FROM lang_n JOIN size USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) x ON (x.lang, x.source, x.item) = (a.lang, a.source, b.source)),
term AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN lang_share USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM term QUALIFY rank <= 50
"""
