"""Line de-duplication by a log-template tree of fixed depth, in DataFrame operations only.

Tokens that hold a digit become ``<*>``. A line descends by its number of tokens, then by its leading
tokens, to a leaf. In a leaf that many documents reach, a position where no token covers more than half
of the leaf's distinct lines is a variable field, and if enough positions are left constant they are
the line's template; else the masked line is. Lines whose template recurs in ``min_docs`` different
documents (``long_docs``, for lines of ``long_words`` words or more) are dropped, but for the document
with the smallest id that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, join_hot_apart, stored, text_or_empty

DEPTH, MIN_DOCS, CONSTANT = 3, 10, 0.6
LONG_WORDS, LONG_DOCS = 50, 3  # lines of so many words don't recur by chance
MOST_BROADCAST = 500_000  # rows of two hashes
BLANK = r"[ \t\r\f\x0b]+"


def masked(line: Column) -> Column:
    """The line with one space between tokens and a mark for each token that holds a digit. Most lines are so
    already, and one search tells."""
    one = F.trim(F.regexp_replace(line, BLANK, " "))
    odd = line.rlike(r"[0-9\t\r\f\x0b]") | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(odd, F.regexp_replace(one, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def _leaf(line: Column, depth: int) -> Column:
    """The number of tokens and the leading ones of a masked line, without cutting it up."""
    return F.xxhash64(_spaces(line), F.substring_index(line, " ", depth))


def _spaces(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))


def recurring_lines(docs: DataFrame, id_col: str, text_col: str, depth: int, min_docs: int, constant: float, long_words: int = LONG_WORDS, long_docs: int = LONG_DOCS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc (hash of the text), lines (hashes of the masked lines to drop from it). Documents with equal texts
    are one document here, so exact copies neither recur nor weigh."""
    text = text_or_empty(text_col)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    lines = base.select("id", F.xxhash64("text").alias("doc"), F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(r"[^ \t\r\f\x0b]")).select("id", "doc", masked(F.col("line")).alias("m"))
    lines = lines.select("id", "doc", "m", F.xxhash64("m").alias("line"), _leaf(F.col("m"), depth).alias("leaf"), (_spaces(F.col("m")) + 1 >= long_words).alias("long"))
    seen = stored(lines.groupBy("leaf", "line", "doc", "long").agg(F.min("id").alias("id")), "line-occurrences")

    # leaves that enough documents reach by more than one line
    busy = seen.groupBy("leaf", "doc").agg(F.min("line").alias("a"), F.max("line").alias("b")).groupBy("leaf").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).filter((F.col("n") >= min_docs) & (F.col("a") != F.col("b")))
    kinds = stored(seen.select("leaf", "line").distinct(), "line-kinds")
    wanted = stored(join_hot_apart(kinds, busy.select("leaf"), ["leaf"], "left_semi"), "line-wanted")
    # a row for each distinct line of these leaves, with its tokens' hashes
    tokens = F.transform(F.split("m", " "), lambda t: F.xxhash64(t)).alias("tokens")
    if wanted.count() <= most_broadcast:
        parsed = lines.select("leaf", "line", "m").join(F.broadcast(wanted), ["leaf", "line"], "left_semi").select("leaf", "line", tokens).groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    else:  # lines that recur in a task are one row before they are shuffled
        parsed = lines.groupBy("leaf", "line").agg(F.first("m").alias("m")).join(wanted, ["leaf", "line"], "left_semi").select("leaf", "line", tokens)
    parsed = stored(parsed, "line-leaves")
    size = parsed.groupBy("leaf").agg(F.count("*").alias("k"))
    most = parsed.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").count().groupBy("leaf", "at").agg(F.max("count").alias("most"))
    fields = most.join(size, "leaf").groupBy("leaf").agg(F.collect_list(F.when(F.col("most") * 2 > F.col("k"), F.col("at"))).alias("fixed"), F.count("*").alias("n")).filter(F.size("fixed") >= constant * F.col("n"))
    templates = join_hot_apart(parsed, fields.select("leaf", "fixed"), ["leaf"]).select("line", F.xxhash64("leaf", F.transform(F.array_sort("fixed"), lambda k: F.col("tokens")[k])).alias("template"))

    placed = stored(join_hot_apart(seen, stored(templates, "line-templates"), ["line"], "left").select("doc", "line", "id", "long", F.coalesce("template", "line").alias("template")), "line-placed")
    owners = placed.groupBy("template", "doc").agg(F.min("id").alias("id"), F.max("long").alias("long")).groupBy("template").agg(F.count("*").alias("n"), F.max("long").alias("long"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc")).alias("first"))
    owners = owners.filter(F.col("n") >= F.when(F.col("long"), min(long_docs, min_docs)).otherwise(min_docs))
    gone = join_hot_apart(placed, stored(owners.select("template", F.col("first.doc").alias("owner")), "line-owners"), ["template"]).filter("doc != owner")
    return gone.groupBy("doc").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT, long_words: int = LONG_WORDS, long_docs: int = LONG_DOCS, counts: tuple[str, str] | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text_col``; with ``counts``, also two
    columns of that name: the lines of the text and those dropped.

    A document keeps its other lines as they are, and white-space lines. A null text stays null; it and
    an empty text have one line, which is never dropped. Repeated rows and null ids are treated alike by
    equal texts (a null id comes last in the choice of the document that keeps a template's lines). All
    other columns stay; an empty table gives no rows. Only hashes are grouped (64 bits for a text, a line, a
    leaf), by line and document at once before either alone, and the rows of hot leaves, lines, templates
    and texts are joined apart, so none of these is gathered in a task; texts move once, to meet their lists
    of lines. That is so however few the lists are, so that inputs of all sizes take one plan.
    """
    gone = stored(recurring_lines(docs, id_col, text_col, depth, min_docs, constant, long_words, long_docs, most_broadcast), "line-gone")
    key, lines = fresh(docs, "_doc", *(counts or ())), fresh(docs, "_gone", *(counts or ()))
    joined = join_hot_apart(docs.withColumn(key, F.xxhash64(text_or_empty(text_col))), gone.select(F.col("doc").alias(key), F.col("lines").alias(lines)).hint("merge"), [key], "left")
    split, left = F.split(F.col(f"`{text_col}`"), "\n"), fresh(joined, "_left", *(counts or ()))
    joined = joined.withColumn(left, F.when(F.col(lines).isNotNull(), F.filter(split, lambda x: ~F.array_contains(F.col(lines), F.xxhash64(masked(x))))))
    kept = F.when(F.col(lines).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(left, "\n"))
    columns = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        breaks = F.length(F.col(f"`{text_col}`")) - F.length(F.replace(F.col(f"`{text_col}`"), F.lit("\n"), F.lit("")))
        n = F.coalesce(breaks + 1, F.lit(1))
        columns += [n.alias(counts[0]), F.when(F.col(lines).isNull(), 0).otherwise(n - F.size(left)).alias(counts[1])]
    return joined.select(*columns)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs, counts=("n_lines", "n_dropped"))


LINES_SQL = r"""
WITH RECURSIVE x AS (SELECT * FROM ({docs})),
raw AS (
  SELECT doc_id, coalesce(text, '') AS doc, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM x
), spaced AS (
  SELECT doc_id, doc, trim(regexp_replace(line, '[ \t\r\f\x0b]+', ' ', 'g'), ' ') AS s FROM raw
), lines AS (
  SELECT doc_id, doc, m, string_split(m, ' ') AS tokens
  FROM (SELECT doc_id, doc, regexp_replace(s, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM spaced) WHERE m <> ''
), seen AS (
  SELECT doc, m, any_value(tokens) AS tokens, min(doc_id) AS id,
         any_value(concat_ws(chr(1), len(tokens), array_to_string(tokens[1:{depth}], chr(2)))) AS leaf, any_value(len(tokens) >= {long_words}) AS long
  FROM lines GROUP BY doc, m
), busy AS (
  SELECT leaf FROM seen GROUP BY leaf HAVING count(DISTINCT doc) >= {min_docs} AND count(DISTINCT m) > 1
), parsed AS (
  SELECT leaf, m, any_value(tokens) AS tokens FROM seen SEMI JOIN busy USING (leaf) GROUP BY leaf, m
), token AS (
  SELECT leaf, m, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos FROM parsed
), most AS (
  SELECT leaf, pos, max(n) AS most FROM (SELECT leaf, pos, t, count(*) AS n FROM token GROUP BY leaf, pos, t) GROUP BY leaf, pos
), fields AS (
  SELECT leaf, list(pos ORDER BY pos) FILTER (most * 2 > k) AS fixed
  FROM most JOIN (SELECT leaf, count(*) AS k FROM parsed GROUP BY leaf) USING (leaf)
  GROUP BY leaf HAVING count(*) FILTER (most * 2 > k) >= {constant} * count(*)
), templates AS (
  SELECT m, concat('t', leaf, chr(3), array_to_string(list_transform(fixed, lambda k: tokens[k]), chr(2))) AS template
  FROM parsed JOIN fields USING (leaf)
), placed AS (
  SELECT doc, m, id, long, coalesce(template, concat('l', m)) AS template FROM seen LEFT JOIN templates USING (m)
), owners AS (
  SELECT template, arg_min(doc, id) AS owner FROM placed GROUP BY template HAVING count(DISTINCT doc) >= CASE WHEN max(long) THEN least({long_docs}, {min_docs}) ELSE {min_docs} END
), gone AS (
  SELECT doc, list(DISTINCT m) AS drops FROM placed JOIN owners USING (template) WHERE doc <> owner GROUP BY doc
), cut AS (
  SELECT x.*, string_split(x.text, chr(10)) AS ls,
         list_filter(string_split(x.text, chr(10)), lambda l: NOT list_contains(drops, regexp_replace(trim(regexp_replace(l, '[ \t\r\f\x0b]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g'))) AS kept,
         drops
  FROM x LEFT JOIN gone ON coalesce(x.text, '') = gone.doc
)
"""

OP10_SQL = (
    LINES_SQL.format(docs="SELECT doc_id, text FROM documents", depth=DEPTH, min_docs=MIN_DOCS, constant=CONSTANT, long_words=LONG_WORDS, long_docs=LONG_DOCS)
    + """SELECT doc_id, CASE WHEN drops IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(ls), 1) AS INTEGER) AS n_lines, CAST(CASE WHEN drops IS NULL THEN 0 ELSE len(ls) - len(kept) END AS INTEGER) AS n_dropped
FROM cut"""
)
