"""Personal data by bootstrapped contextual extraction.

Strict patterns find e-mail and IP addresses, cards and phone numbers; these are the seeds. The words beside them
become lexical patterns ("the word before", "the two words before", "the word after"). Spark scores the graph of
patterns and instances in rounds: a pattern is as good as the trusted share of all places where its words occur, an
instance as its second-best pattern, so no pattern can vouch for itself. Identifiers that no strict pattern
accepts, in the slot of a high-confidence pattern, are found besides.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import begin, join_hot_apart, rows_of, stored, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
WINDOW, ONE = 48, 1_000_000  # characters beside a span in which its words are looked for; scores are in millionths
MASK_BITS, MOST_HELD = 24, 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+(?:[ ().-]{1,2}[0-9]+)*")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_DOTS = re.compile(r"[0-9]+(?:\.[0-9]+){2,}")
_NAME = re.compile(r"[^\s@,;:<>()\"'\[\]{}|]+")
_ENDS = " \t\n\r,;:<>()\"'[]{}|"
_WORDS = re.compile(r"[^\W\d_]+")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(_DOUBLED[d] for d in own[1::2])) % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, from the @ signs: what
    goes before one is taken back to the last match or other character, so long runs without one cost nothing."""
    end = 0
    for m in _DOMAIN.finditer(text):
        before = text[max(end, text.rfind("@", end, m.start()) + 1) : m.start()]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            yield m.start() - local, m.end()
            end = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by strict pattern, in order; ends are exclusive."""
    found = [(0, *x) for x in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(own := _digits(m.group())) <= 19 and luhn(own):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def _loose(text: str):
    """(start, end, kinds it could be) of what looks like an identifier: a number of 6 to 19 digits in groups, a
    name with an @, or hexadecimal groups between colons."""
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 6:
            s, n = m.group(), len(_digits(m.group()))
            kinds = ([1] if _DOTS.fullmatch(s) and n <= 15 else []) + ([2] if 12 <= n <= 19 else []) + ([3] if 6 <= n <= 15 else [])
            if kinds:
                yield m.start(), m.end(), kinds
    if text.count(":") > 1:
        yield from ((m.start(), m.end(), [1]) for m in _COLONS.finditer(text))
    at, done = text.find("@"), 0
    while at >= 0:
        start = max(text.rfind(c, done, at) for c in _ENDS) + 1
        m = _NAME.match(text, at + 1)
        if m and max(start, done) < at:
            yield max(start, done), m.end(), [0]
        done = m.end() if m else at + 1
        at = text.find("@", done)


def unknown_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """The loose identifiers that neither overlap a base span nor one that begins before them, in order."""
    out, end, k = [], 0, 0
    strict = sorted((s, e) for _, s, e in base)
    for s, e, kinds in sorted(_loose(text)):
        while k < len(strict) and strict[k][1] <= s:
            k += 1
        if s >= end and (k == len(strict) or strict[k][0] >= e):  # later ones begin no earlier
            out.append((s, e, kinds))
            end = e
    return out


def normal(text: str) -> str:
    """A-Z in lower case; as long as the text."""
    return text.encode().lower().decode()


def contexts(low: str, start: int, end: int) -> list[tuple[str, str]]:
    """(side, words): the word before, the two before, the word after, within WINDOW characters. A word that the
    window cuts doesn't count."""
    a, b = max(0, start - WINDOW), min(len(low), end + WINDOW)
    left = [m.group() for m in _WORDS.finditer(low[a:start]) if m.start() > 0 or a == 0][-2:]
    right = next((m.group() for m in _WORDS.finditer(low[end:b]) if m.end() < b - end or b == len(low)), None)
    out = [("before", left[-1])] if left else []
    if len(left) == 2:
        out.append(("before", " ".join(left)))
    return out + ([("after", right)] if right else [])


def _value(low: str) -> str:
    return hashlib.blake2b(low.encode(), digest_size=16).hexdigest()


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")])
_PLACE = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("known", T.IntegerType()), T.StructField("kinds", T.ArrayType(T.IntegerType())),
    T.StructField("value", T.StringType()), T.StructField("contexts", T.ArrayType(T.StructType([T.StructField("side", T.StringType()), T.StructField("words", T.StringType())]))),
])


def _scan(schema: pa.Schema):
    def run(batches):
        begin()
        task, row = TaskContext.get().partitionId() << 33, 0
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                spans, places = [], []
                for text in b.column("text").to_pylist():
                    base, low, own = base_spans(text), None, []
                    loose = unknown_spans(text, base)
                    if base or loose:
                        low = normal(text)
                    for s, e, known, kinds in [(s, e, k, [k]) for k, s, e in base] + [(s, e, -1, kinds) for s, e, kinds in loose]:
                        own.append({"start": s, "end": e, "known": known, "kinds": kinds, "value": _value(low[s:e]), "contexts": [{"side": x, "words": w} for x, w in contexts(low, s, e)]})
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                    places.append(own)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(range(task + row, task + row + n), pa.int64()), b.column("id").cast(schema.field("id").type), pa.array(spans, schema.field("base").type), pa.array(places, schema.field("places").type)], schema=schema)
                row += n

    return run


def _place_of(words: str) -> int:
    return zlib.crc32(words.encode()) & ((1 << MASK_BITS) - 1)


def _marks(batches):
    """Which bits of the mask the contexts set, as (word of 64 bits, bits)."""
    for (words,) in rows_of(batches, "words"):
        own: dict[int, int] = {}
        for w in words:
            i = _place_of(w)
            own[i >> 5] = own.get(i >> 5, 0) | 1 << (i & 31)
        yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["at", "bits"])


def _occurrences(mask):
    """words, n: how often one word or two in a row occur, for those whose bit is set (a few others may be among them)."""

    def drain(counts):
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["words", "n"])
        counts.clear()

    def run(batches):
        begin()
        bits, counts = mask.value, Counter()

        def wanted(words):
            i = _place_of(words)
            return bits[i >> 3] >> (i & 7) & 1

        for (texts,) in rows_of(batches, "text"):
            for text in texts:
                words = _WORDS.findall(normal(text))
                own = {w: n for w, n in Counter(words).items() if wanted(w)}
                for w, n in own.items():
                    counts[w] += n
                # two words are only asked for if the second alone is, as what supports both supports that one
                for (a, b), n in Counter(zip(words, words[1:], strict=False)).items():
                    if b in own and wanted(pair := f"{a} {b}"):
                        counts[pair] += n
                if len(counts) > MOST_HELD:
                    yield from drain(counts)
        yield from drain(counts)

    return run


def _mask(contexts_: DataFrame):
    """A bit for each of the contexts, by hash: 2 MB whatever their number."""
    spark = contexts_.sparkSession
    words = contexts_.select("words").mapInArrow(_marks, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    bits = bytearray(1 << (MASK_BITS - 3))
    for r in words.collect():  # at most 2 ** 19 rows of 32 bits
        bits[4 * r["at"] : 4 * r["at"] + 4] = r["bits"].to_bytes(4, "little")
    return spark.sparkContext.broadcast(bytes(bits))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


class Extraction:
    """The steps and their tables. ``rows``: uid, id, base spans and places (base and unknown ones, with their
    contexts). ``edges``: pattern (side, words), instance (value, known, kinds) and w, how often they meet.
    ``viable``: the patterns of each kind that could reach ``confident``, with total. ``patterns``: their scores."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, confident: int = 750_000, seeds: int = 3):
        self.confident = confident
        base = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
        schema = T.StructType([T.StructField("uid", T.LongType()), base.schema["id"], T.StructField("base", T.ArrayType(_SPAN)), T.StructField("places", T.ArrayType(_PLACE))])
        self.rows = stored(base.mapInArrow(_scan(to_arrow_schema(schema)), schema), "pii-rows")
        met = self.rows.select(F.explode("places").alias("p")).select("p.known", "p.kinds", "p.value", F.explode("p.contexts").alias("c"))
        self.edges = stored(met.groupBy("c.side", "c.words", "value", "known", "kinds").agg(F.count("*").alias("w")), "pii-edges")
        seen = self.edges.filter("known >= 0").groupBy("side", "words", F.col("known").alias("kind")).agg(F.count("*").alias("seeds"), F.sum("w").alias("trusted")).filter(F.col("seeds") >= seeds)
        seen = stored(seen, "pii-seeded")
        totals = base.select("text").mapInArrow(_occurrences(_mask(seen)), "words string, n long").groupBy("words").agg(F.sum("n").alias("total"))
        could = self.edges.select("side", "words", F.explode("kinds").alias("kind"), "w").groupBy("side", "words", "kind").agg(F.sum("w").alias("most"))
        all_of_it = self.edges.groupBy("side", "words").agg(F.sum("w").alias("slots"))
        viable = seen.join(totals, "words").join(could, ["side", "words", "kind"]).join(all_of_it, ["side", "words"]).withColumn("total", F.greatest("total", "slots"))
        self.viable = stored(viable.filter(F.col("most") * ONE >= confident * (F.col("total") + 1)).select("side", "words", "kind", "trusted", "total"), "pii-viable")
        self.patterns = self._scored(rounds)

    def _scored(self, rounds: int) -> DataFrame:
        """side, words, kind, score after ``rounds`` rounds. A seed counts fully for its kind. A pattern's score is the
        share of what its words surround (plus one) that is trusted; an unknown instance is trusted as far as its
        second-best pattern of a kind goes."""
        unknown = self.edges.filter("known < 0").withColumn("kind", F.explode("kinds")).select("side", "words", "kind", "value", "w")
        unknown = stored(join_hot_apart(unknown, self.viable.select("side", "words", "kind"), ["side", "words", "kind"]), "pii-unknown")
        score = F.least(F.lit(ONE), F.floor((F.col("trusted") * ONE + F.coalesce("more", F.lit(0))) / (F.col("total") + 1))).cast("long")
        more = None
        for k in range(rounds):
            of = self.viable.withColumn("more", F.lit(0)) if more is None else self.viable.join(more, ["side", "words", "kind"], "left")
            scores = stored(of.select("side", "words", "kind", score.alias("score")), "pii-scores")
            if k + 1 < rounds:
                with_score = stored(join_hot_apart(unknown, scores, ["side", "words", "kind"]), "pii-scored")
                order = Window.partitionBy("value", "kind").orderBy(F.col("score").desc())
                second = with_score.select("value", "kind", "score", F.row_number().over(order).alias("k")).filter("k = 2").select("value", "kind", F.col("score").alias("trust"))
                more = join_hot_apart(with_score, second, ["value", "kind"]).groupBy("side", "words", "kind").agg(F.sum(F.col("w") * F.col("trust")).alias("more"))
        return scores

    def found(self) -> DataFrame:
        """uid and span (kind, start, end) of unknown identifiers beside a high-confidence pattern; of several kinds
        the one with the best pattern, then the first."""
        places = self.rows.select("uid", F.explode("places").alias("p")).filter("p.known < 0").select("uid", "p.start", "p.end", F.explode("p.kinds").alias("kind"), F.col("p.contexts").alias("c"))
        places = places.select("uid", "start", "end", "kind", F.explode("c").alias("c")).select("uid", "start", "end", "kind", "c.side", "c.words")
        sure = self.patterns.filter(F.col("score") >= self.confident)
        best = join_hot_apart(places, sure, ["side", "words", "kind"]).groupBy("uid", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("first"))).alias("best"))
        return best.select("uid", F.struct((-F.col("best.first")).cast("int").alias("kind"), "start", "end").alias("span"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """One row per row of ``docs``: id_col, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as text), spans
    (all spans as text). ``settings``: those of ``Extraction``.

    A null text has no spans. Repeated rows and null ids give a row each; an empty table gives no rows;
    other columns, whatever their names, aren't read. Texts are read whole, in time that grows with their length.
    """
    got = Extraction(docs, id_col=id_col, **settings)
    more = got.found().groupBy("uid").agg(F.collect_list("span").alias("found"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    all_spans = F.array_sort(F.concat("base", F.coalesce("found", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    rows = got.rows.select("uid", "id", "base").join(more, "uid", "left")
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_joined(F.array_sort("base")), 256).alias("base_sha256"), _joined(all_spans).alias("spans"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
