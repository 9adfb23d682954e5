"""BM25: an index of a corpus, for one search or stored with delta segments, and exact top-k with pruning."""

from __future__ import annotations

import json
import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import settled
from .batches import slices
from .knn import Best

K1, B, EPSILON = 1.5, 0.75, 0.25
MOST_TERMS = 100_000  # distinct terms of queries that are broadcast
SEEDS, BLOCK, MOST_SEGMENTS, PUSHED = 20, 128, 8, 500
MOST_LOOKED_UP = 200_000  # rows of a query, a document and a term that are broadcast
TOKENS = 100_000  # of texts that are counted in Python at once
MOST_ASKED, GROUP_TERMS = 200_000, 8192  # rows (query, term) that go to all tasks at once, and that make one matrix


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, dl (how many tokens), terms and tfs, a row for each document: each text is cut once, and what it holds
    is counted where it lies."""
    cut = docs.select(F.col(id_col).alias("doc_id"), X.bm25_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    ids = cut.schema["doc_id"]

    def run(batches):
        for whole in batches:
            for b in slices(whole, "tokens", TOKENS):
                counts = [Counter(t) for t in b.column("tokens").to_pylist()]
                columns = [b.column("doc_id"), pa.array([c.total() for c in counts], pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "dl", "terms", "tfs"])

    return cut.mapInArrow(run, f"doc_id {ids.dataType.simpleString()}, dl int, terms array<string>, tfs array<int>")


def postings(rows: DataFrame) -> DataFrame:
    """term, doc_id, tf, dl of ``counted`` rows."""
    return rows.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), "doc_id", F.col("p.tfs").alias("tf"), "dl")


def _term_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def _with_idf(sizes: DataFrame, n: int) -> tuple[DataFrame, float]:
    """Idf is ln(N - df + 0.5) - ln(df + 0.5); negative ones become a quarter of the mean idf, which comes along."""
    raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = sizes.agg(F.avg(raw)).first()[0] or 0.0
    return sizes.withColumn("idf", F.when(raw < 0, EPSILON * mean).otherwise(raw)), mean


class BM25Index:
    """``term_stats`` (term, df, max_tf, min_dl, idf) and ``corpus`` (n, avgdl; one row) of a corpus, and searches in
    it. Ids must be distinct; a null text has no tokens."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        self.rows = settled(counted(docs, id_col, text_col), "bm25-rows")
        self.postings = postings(self.rows)
        n, total = self.rows.agg(F.count("*"), F.sum("dl")).first()
        self._sized(n, total)
        self.term_stats, _ = _with_idf(settled(_term_sizes(self.postings), "bm25-terms"), n)

    def _sized(self, n: int, total: int | None) -> None:
        self.n, self.avgdl = n, (total or 0) / n if n else 0.0
        self.corpus = self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(self.avgdl).alias("avgdl"))

    def _part(self, tf: Column | str, dl: Column | str) -> Column:
        """What a term adds for each unit of its weight: more for a larger tf, less for a longer text."""
        tf, dl = (F.col(x) if isinstance(x, str) else x for x in (tf, dl))
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (self.avgdl or 1.0)))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """query_id, term, w (weight: repeated terms count as often) and most, what the term can add to a score."""
        terms = queries.select("query_id", F.explode(X.bm25_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        w = F.col("qtf") * F.col("idf")
        few = terms.select("term").distinct()
        stats = self.term_stats.join(F.broadcast(few) if few.limit(MOST_TERMS + 1).count() <= MOST_TERMS else few, "term", "left_semi")
        return stats.join(terms, "term").select("query_id", "term", "df", w.alias("w"), F.greatest(F.lit(0.0), w * self._part("max_tf", "min_dl")).alias("most"))

    def _postings_of(self, terms: DataFrame) -> DataFrame:
        """term, doc_id, tf, dl of ``terms`` (distinct, each a row), with the columns that terms has besides."""
        return self.postings.join(terms, "term")

    def _added(self, terms: DataFrame) -> DataFrame:
        """query_id, doc_id and what each of the terms (query_id, term, w) adds."""
        return self._postings_of(terms).select("query_id", "doc_id", (F.col("w") * self._part("tf", "dl")).alias("part"))

    def scores(self, queries: DataFrame) -> DataFrame:
        """queries(query_id, query): every document that shares a term with the query, with its score."""
        return self._added(self._asked(queries)).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))

    def search(self, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
        """The best k documents of each query, exactly: documents by terms times terms by queries, block by block in
        Arrow, each task with k rows a query. ``digits``: round scores before ranking, so that sums taken in
        another order rank alike. The queries' terms go to every task, MOST_ASKED at a time."""
        from .retrieval import ranked, top_k_of

        k = top_k_of(k)
        asked = settled(self._asked(queries).select("query_id", "term", "w"), "bm25-asked")
        parts, out = max(1, -(-asked.count() // MOST_ASKED)), None
        for p in range(parts):
            part = self.rows.mapInArrow(_products(self, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p), k, digits), asked.select("query_id").schema.add("doc_id", self.rows.schema["doc_id"].dataType).add("score", "double"))
            out = part if out is None else out.unionByName(part)
        return ranked(out, k)


def _products(index: BM25Index, asked: DataFrame, k: int, digits: int | None):
    """Of batches of ``counted`` rows: query_id, doc_id, score, the best k of each query in the task."""
    table = asked.orderBy("query_id").toArrow()  # about MOST_ASKED rows
    schema = pa.schema([table.schema.field("query_id"), ("doc_id", to_arrow_type(index.rows.schema["doc_id"].dataType)), ("score", pa.float64())])
    sent, avgdl = asked.sparkSession.sparkContext.broadcast(table), index.avgdl or 1.0

    def groups():
        """Queries, terms and their weights as a matrix, for some GROUP_TERMS rows of what is asked each."""
        import numpy as np

        table = sent.value
        query = table.column("query_id").combine_chunks().dictionary_encode()
        number = query.indices.to_numpy()
        begin = 0
        while begin < len(number):
            end = min(begin + GROUP_TERMS, len(number))
            while end < len(number) and number[end] == number[end - 1]:
                end += 1
            term = table.column("term").slice(begin, end - begin).combine_chunks().dictionary_encode()
            first = number[begin]
            weights = np.zeros((len(term.dictionary), number[end - 1] - first + 1))
            weights[term.indices.to_numpy(), number[begin:end] - first] = table.column("w").slice(begin, end - begin).to_numpy()
            yield query.dictionary.slice(first, weights.shape[1]), term.dictionary, weights
            begin = end

    def run(batches):
        import numpy as np

        own = [(q, terms, w, Best(k)) for q, terms, w in groups()]
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                ids, dl, lists = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("dl").to_numpy(), b.column("terms")
                row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
                flat, tf = lists.flatten(), b.column("tfs").flatten().to_numpy().astype(float)
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
                for _, terms, w, best in own:
                    at = pc.index_in(flat, terms)
                    met = at.is_valid().to_numpy(zero_copy_only=False)
                    column = at.drop_null().to_numpy()
                    for d in range(0, b.num_rows, step := max(16, 8_000_000 // max(1, len(terms)))):
                        some = (row[met] >= d) & (row[met] < d + step)
                        m = np.zeros((min(step, b.num_rows - d), len(terms)))
                        m[row[met][some] - d, column[some]] = part[met][some]
                        score = m @ w
                        shares = score > 0 if (w >= 0).all() else (m > 0).astype(np.float32) @ (w != 0).astype(np.float32) > 0
                        if digits is not None:
                            score = np.floor(score * 10**digits + 0.5) / 10**digits
                        if len(score) > k:  # what isn't among the block's best k (or ties with them) isn't among all
                            shares &= score >= np.partition(np.where(shares, score, -np.inf), len(score) - k, axis=0)[len(score) - k]
                        doc, q = np.nonzero(shares)
                        best.add(q, ids[d + doc], score[doc, q])
        for q, _, _, best in own:
            if len(best.q):
                yield pa.RecordBatch.from_arrays([q.take(pa.array(best.q)).cast(schema.field(0).type), pa.array(best.id, schema.field(1).type), pa.array(best.score)], schema=schema)

    return run


def _blocks(batches):
    """Rows sorted by term as blocks of at most BLOCK of one term: the lists, and the largest tf and the shortest
    text in them, which bound what any of them adds to a score."""
    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        terms = b.column("term")
        new = np.r_[True, np.array(terms[1:].to_numpy(zero_copy_only=False) != terms[:-1].to_numpy(zero_copy_only=False), bool)]
        run = np.cumsum(new) - 1
        place = np.arange(b.num_rows) - np.flatnonzero(new)[run]
        begins = np.flatnonzero(new | (place % BLOCK == 0))
        offsets = pa.array(np.r_[begins, b.num_rows], pa.int32())
        tf, dl = (b.column(c).to_numpy() for c in ("tf", "dl"))
        lists = [pa.ListArray.from_arrays(offsets, b.column(c)) for c in ("doc_id", "tf", "dl")]
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(begins)), pa.array(np.diff(np.r_[begins, b.num_rows]), pa.int32()), pa.array(np.maximum.reduceat(tf, begins), pa.int32()), pa.array(np.minimum.reduceat(dl, begins), pa.int32()), *lists], names=["term", "n", "max_tf", "min_dl", "ids", "tfs", "dls"])


class StoredIndex(BM25Index):
    """An index at ``path``: segments of postings in blocks, ordered by term, and of documents with their terms, a
    table of all terms, and a pointer
    file that names what is current, so readers see the state before an append or after it.

    A search reads the blocks of its queries' terms (by the files' statistics, if the terms are few), and of these only
    the lists of blocks that can lift a document over the query's bar.
    """

    def __init__(self, spark: SparkSession, path: str):
        from ..sources.sinks import _read_text

        self.spark, self.path = spark, path
        text = _read_text(spark, f"{path}/_CURRENT")
        if text is None:
            raise FileNotFoundError(f"no index at {path}")
        self.state = json.loads(text)
        self._sized(self.state["n"], self.state["total"])
        self.term_stats = spark.read.parquet(f"{path}/{self.state['terms']}")
        self.blocks = spark.read.parquet(*[f"{path}/{s}/postings" for s in self.state["segments"]])
        self.rows = spark.read.parquet(*[f"{path}/{s}/docs" for s in self.state["segments"]])

    @classmethod
    def append(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most_segments: int = MOST_SEGMENTS) -> StoredIndex:
        """The index at ``path`` (made if there is none) with ``docs`` besides; ids that it has already are skipped,
        and ids that repeat within ``docs`` are an error. Each text is cut once. The new documents are a segment of their own; beyond ``most_segments`` all are merged."""
        from ..sources.sinks import _read_text

        spark = docs.sparkSession
        text = _read_text(spark, f"{path}/_CURRENT")
        state = json.loads(text) if text else {"segments": [], "n": 0, "total": 0}
        new = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        if state["segments"]:  # ids alone are compared, and texts only move if some are known
            known = spark.read.parquet(*[f"{path}/{s}/docs" for s in state["segments"]]).select("doc_id").join(new.select("doc_id"), "doc_id", "left_semi")
            known = settled(known, "bm25-known")
            new = new if known.isEmpty() else new.join(known, "doc_id", "left_anti")
        rows = settled(counted(new), "bm25-rows")
        if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
            raise ValueError("ids must be distinct")
        segment = f"segment-{uuid.uuid4().hex}"
        cls._write(postings(rows), f"{path}/{segment}/postings")
        rows.write.parquet(f"{path}/{segment}/docs")
        n, total = spark.read.parquet(f"{path}/{segment}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        state = {"segments": [*state["segments"], segment], "n": state["n"] + n, "total": state["total"] + total}
        if len(state["segments"]) > most_segments:
            state["segments"] = [cls._merged(spark, path, state["segments"])]
        return cls._publish(spark, path, state)

    @staticmethod
    def _write(rows: DataFrame, to: str) -> None:
        kind = rows.schema["doc_id"].dataType.simpleString()
        ordered = rows.select("term", "doc_id", "tf", "dl").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        blocks = ordered.mapInArrow(_blocks, f"term string, n int, max_tf int, min_dl int, ids array<{kind}>, tfs array<int>, dls array<int>")
        blocks.write.option("parquet.block.size", 8 << 20).parquet(to)

    @classmethod
    def _merged(cls, spark: SparkSession, path: str, segments: list[str]) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        blocks = spark.read.parquet(*[f"{path}/{s}/postings" for s in segments])
        cls._write(cls._exploded(blocks, "term"), f"{path}/{name}/postings")
        spark.read.parquet(*[f"{path}/{s}/docs" for s in segments]).write.parquet(f"{path}/{name}/docs")
        return name

    @classmethod
    def _publish(cls, spark: SparkSession, path: str, state: dict) -> StoredIndex:
        from ..sources.sinks import _write_text

        blocks = spark.read.parquet(*[f"{path}/{s}/postings" for s in state["segments"]])
        sizes = settled(blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")))
        terms, mean = _with_idf(sizes, state["n"])
        state |= {"terms": f"terms-{uuid.uuid4().hex}", "mean_idf": mean}
        terms.repartitionByRange("term").sortWithinPartitions("term").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/{state['terms']}")
        _write_text(spark, f"{path}/_CURRENT", json.dumps(state))
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, digits: int | None = None, by: str | None = None) -> DataFrame:
        """The best k documents of each query, exactly. ``digits``: round scores before ranking, so that sums taken
        in another order rank alike. ``by``: ``lists`` reads the lists of the queries' terms, ``rows`` all documents
        once, as an index that isn't stored does; by default the latter if the queries' lists hold more than all
        documents do. The results are the same.

        The terms that can add most, of as many documents as make some multiple of k, give each query k likely
        results; the worst of their whole scores is a bar that no result is below. Terms that together can't reach
        the bar bring no candidates; the others' postings are summed, and only documents that can still pass the bar are
        looked up in the lists of the rest. Where a weight is negative there is no bar, and all documents with a
        term of the query are candidates.
        """
        from .retrieval import ranked, top_k_of

        if by is None:
            lists, rows = (x.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] for x in (self._asked(queries), self.term_stats))
            by = "rows" if lists > rows else "lists"
        if by == "rows":
            return super().search(queries, k, digits)
        k = top_k_of(k)
        query = Window.partitionBy("query_id")
        best_first = query.orderBy(F.col("most").desc(), "term").rowsBetween(Window.unboundedPreceding, -1)
        asked = self._asked(queries).select("*", (F.coalesce(F.sum("df").over(best_first), F.lit(0)) < SEEDS * k).alias("seed"), F.sum("most").over(query).alias("all_most"), F.min("w").over(query).alias("least_w"))
        asked = settled(asked.filter("least_w is not null"), "bm25-asked")
        nth = F.row_number().over(query.orderBy(F.col("sum").desc()))
        likely = self._added(asked.filter("seed and least_w >= 0")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("sum")).withColumn("nth", nth).filter(F.col("nth") <= k)
        likely = settled(likely.drop("nth"), "bm25-likely")  # at most k a query
        whole = self._completed(likely, asked.filter("not seed"))
        bar = whole.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bar")).filter(F.col("n") == k)
        bar = bar.select("query_id", (F.col("bar") * (1 - 1e-9) - (1e-9 if digits is None else 10.0**-digits)).alias("bar"))
        up_to_here = F.sum("most").over(query.orderBy("most", F.col("term").desc()).rowsBetween(Window.unboundedPreceding, 0))
        split = asked.join(bar, "query_id", "left").withColumn("brings", F.coalesce(up_to_here >= F.col("bar"), F.lit(True)))
        split = split.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("brings"), F.col("most"))).over(query), F.lit(0.0))).withColumn("needs", F.col("bar") - F.col("all_most") + F.col("most"))
        split = settled(split, "bm25-split")
        first = self._added(split.filter("brings").select("query_id", "term", "w", "needs")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("sum"))
        able = first.join(split.select("query_id", "rest", "bar").distinct(), "query_id").filter(F.coalesce(F.col("sum") + F.col("rest") >= F.col("bar"), F.lit(True)))
        able = settled(able.select("query_id", "doc_id", "sum"), "bm25-able")
        scores = self._completed(able, split.filter("not brings"))
        return ranked(scores.withColumn("score", F.round("score", digits)) if digits is not None else scores, k)

    def _completed(self, sums: DataFrame, others: DataFrame) -> DataFrame:
        """query_id, doc_id, score: the sums (query_id, doc_id, sum) and what the ``others`` (query_id, term, w, df) add.
        Each document is looked up in each list, if that is less than the lists hold, else the lists are added up: then
        documents that aren't in ``sums`` come along, with less than their score."""
        sizes = sums.groupBy("query_id").agg(F.count("*").alias("docs")).join(others.groupBy("query_id").agg(F.count("*").alias("terms")), "query_id")
        looked, (held,) = sizes.agg(F.coalesce(F.sum(F.col("docs") * F.col("terms")), F.lit(0))).first()[0], others.agg(F.coalesce(F.sum("df"), F.lit(0))).first()
        if looked > held / 4:
            more = self._added(others.select("query_id", "term", "w")).withColumnRenamed("part", "sum")
        else:
            wanted = sums.join(others, "query_id").select("query_id", "doc_id", "term", "w")
            wanted = F.broadcast(wanted) if looked <= MOST_LOOKED_UP else wanted
            more = self._postings_of(others.select("term").distinct()).join(wanted, ["term", "doc_id"]).select("query_id", "doc_id", (F.col("w") * self._part("tf", "dl")).alias("sum"))
        return sums.unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("sum").alias("score"))

    @staticmethod
    def _exploded(blocks: DataFrame, *also: str) -> DataFrame:
        zipped = F.explode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl")))
        return blocks.select(*also, zipped.alias("p")).select(*also, "p.doc_id", "p.tf", "p.dl")

    def _postings_of(self, terms: DataFrame) -> DataFrame:
        few = [r[0] for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
        blocks = self.blocks.filter(F.col("term").isin(few)) if len(few) <= PUSHED else self.blocks
        met = blocks.join(terms, "term")
        if "needs" in terms.columns:  # a block none of whose documents can reach the bar goes unread
            met = met.filter(F.coalesce(F.col("w") * self._part("max_tf", "min_dl") >= F.col("needs"), F.lit(True)))
        return self._exploded(met, *terms.columns)
