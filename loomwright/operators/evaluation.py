"""Answer quality from token overlap: faithfulness, relevancy, precision, recall, a judge's heuristic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import let

METRICS = ["faithfulness", "relevancy", "context_precision", "context_recall"]


def _share(of: Column, within: Column, empty: float) -> Column:
    return F.when(F.size(of) == 0, empty).otherwise(F.size(F.array_intersect(of, within)) / F.size(of))


def _words(text: Column) -> Column:
    return X.ascii_words(F.coalesce(text, F.lit("")), X.EVALUATOR_STOP_WORDS)


def evaluated(rows: DataFrame) -> DataFrame:
    """rows(question, answer, contexts, ground_truth) with the four scores. An empty answer or no context has
    faithfulness 0, an answer without counted words 1; without relevance marks precision is the mean of the
    question's share in each context, weighted by 1 / position. Every text is cut into words once; those of
    all contexts are the words of each, put together."""
    contexts = F.coalesce("contexts", F.array().cast("array<string>"))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    words = F.struct(*[_words(F.col(c)).alias(c) for c in ("question", "answer", "ground_truth")], F.transform(contexts, _words).alias("each"))

    def scores(w: Column) -> Column:
        q, a, g = w["question"], w["answer"], w["ground_truth"]
        every = F.array_distinct(F.flatten(w["each"]))
        none = ~F.exists(contexts, lambda x: ~blank(x))
        shares = F.transform(w["each"], lambda x, k: _share(q, x, 0.0) / (k + 1))
        weights = F.transform(w["each"], lambda x, k: F.lit(1.0) / (k + 1))
        add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        return let(every, lambda c: F.struct(
            F.when(blank(F.col("answer")) | none, 0.0).otherwise(_share(a, c, 1.0)).alias(METRICS[0]),
            F.when(blank(F.col("answer")) | blank(F.col("question")), 0.0).otherwise(_share(q, a, 0.0)).alias(METRICS[1]),
            F.when(F.size(w["each"]) > 0, add(shares) / add(weights)).otherwise(0.0).alias(METRICS[2]),
            F.when(blank(F.col("ground_truth")) | none, 0.0).otherwise(_share(g, c, 0.0)).alias(METRICS[3]),
        ))

    return rows.withColumn("_scores", let(words, scores)).select(*rows.columns, "_scores.*")


def given_precision(marks: DataFrame) -> DataFrame:
    """marks(query_id, position from 1, relevant): the mean of (relevant so far / position) over relevant ones."""
    from pyspark.sql.window import Window

    hits = F.sum(F.col("relevant").cast("int")).over(Window.partitionBy("query_id").orderBy("position"))
    found = marks.withColumn("hits", hits).filter("relevant")
    return found.groupBy("query_id").agg(F.avg(F.col("hits") / F.col("position")).alias("context_precision"))


def batch_summary(scores: DataFrame) -> DataFrame:
    """Mean and count of each metric's valid scores."""
    out = []
    for m in METRICS:
        ok = F.when(F.col(m).between(0, 1), F.col(m))
        out += [F.avg(ok).alias(f"mean_{m}"), F.count(ok).alias(f"n_{m}")]
    return scores.agg(*out)


def judged(rows: DataFrame) -> DataFrame:
    """rows(question, answer, context) with faithfulness, relevance (0.75 question + 0.25 context coverage by the
    answer) and their grades from 5 to 1 (bounds 0.8, 0.6, 0.4, 0.2)."""
    words = F.struct(*[X.ascii_words(F.coalesce(F.col(x), F.lit("")), X.JUDGE_STOP_WORDS).alias(x) for x in ("question", "answer", "context")])
    grade = lambda x: F.when(x >= 0.8, 5).when(x >= 0.6, 4).when(x >= 0.4, 3).when(x >= 0.2, 2).otherwise(1)
    shares = let(words, lambda w: F.struct(_share(w["answer"], w["context"], 0.0).alias("f"), _share(w["question"], w["answer"], 0.0).alias("c")))
    scores = let(shares, lambda s: F.struct(s["f"].alias("faithfulness"), (0.75 * s["c"] + 0.25 * s["f"]).alias("relevance")))
    graded = rows.withColumn("_s", scores).select(*rows.columns, "_s.*")
    return graded.withColumns({"faithfulness_grade": grade(F.col("faithfulness")), "relevance_grade": grade(F.col("relevance"))})
