"""Quality classifier: document evidence combined with hierarchical empirical-Bayes site priors.

A small classifier gives each document the odds of being unwanted (low quality or toxic). Grouped
sums of these over paths and hosts give site rates; a host's rate is shrunk towards the global rate and
a path's towards its host's, the more the fewer documents it has, with strengths estimated from the
spread between sites. A document's posterior odds are its own evidence times its site's prior odds.
"""

from __future__ import annotations

import math
import operator
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, fresh, join_hot_apart, stored, text_or_empty

MAX_LABELLED, PREFIX = 12_000, 5
MOST_BROADCAST = 200_000  # rows of a site
_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS, _UPPER, _DIGITS = b"!#$%&*+/<=>@[\\]^_`{|}~", bytes(range(65, 91)), b"0123456789"
FEATURES = ["bias", "symbols", "uppercase", "digits", "adjacent_repeats", "symbol_words", "distinct_share", "log_words", "terms", "terms_per_word", "term_weight"]


def terms_of(words: list[str]) -> set[str]:
    """Words and, with a star, the beginnings of longer ones."""
    own = set(words)
    return own | {w[:PREFIX] + "*" for w in own if len(w) > PREFIX} | {w[: PREFIX - 1] + "*" for w in own if len(w) >= PREFIX}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    raw, tokens, words = text.encode(), text.split(), _WORD.findall(text.lower())
    n, size = max(1, len(tokens)), max(1, len(raw))
    own = set(words)
    hits = own & lexicon.keys()
    rest = own - hits
    hits |= {w[:PREFIX] + "*" for w in rest} & lexicon.keys() | {w[: PREFIX - 1] + "*" for w in rest} & lexicon.keys() if lexicon else set()
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    return [
        1.0, min(1, 10 * share(_SYMBOLS)), share(_UPPER), min(1, 5 * share(_DIGITS)),
        sum(map(operator.eq, tokens, tokens[1:])) / n,
        sum(1 for t in set(tokens) if len(t) < 4 and not t.isalnum()) and sum(1 for t in tokens if len(t) < 4 and not any(map(str.isalnum, t))) / n,
        len(own) / max(1, len(words)) if len(words) > 20 else 0.7, math.log1p(len(words)) / 10,
        math.log1p(min(len(hits), 20)), min(1, 50 * len(hits) / n), min(20, sum(sorted((lexicon[h] for h in hits), reverse=True)[:8])) / 10,
    ]


class Model:
    """Two logistic heads over ``features``; the odds of either."""

    def __init__(self, lexicon: dict[str, float], heads: list[list[float]], base: float):
        self.lexicon, self.heads, self.base = lexicon, heads, base

    def unwanted(self, text: str) -> float:
        x, keep = features(text, self.lexicon), 1.0
        for w in self.heads:
            z = sum(map(operator.mul, w, x))
            keep *= 1 / (1 + math.exp(max(-30, min(30, z))))
        return min(max(1 - keep, 1e-6), 1 - 1e-6)


def logistic(x, y, ridge: float = 1e-2, steps: int = 40):
    """Weights by Newton's method with a ridge; a class that is absent gives its smoothed rate alone."""
    import numpy as np

    n = len(y)
    w = np.zeros(x.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    if 0 < y.sum() < n:
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            penalty = np.full(len(w), ridge)
            penalty[0] = 1e-6
            gradient = x.T @ (y - p) - penalty * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
    return w


def _count_terms(batches):
    from collections import Counter

    seen, toxic = Counter(), Counter()
    for b in batches:
        for text, bad in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            terms = terms_of(_WORD.findall(text.lower()))
            seen.update(terms)
            if bad:
                toxic.update(terms)
    terms = list(seen)
    for k in range(0, len(terms), 50_000):
        own = terms[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([seen[t] for t in own], pa.int64()), pa.array([toxic[t] for t in own], pa.int64())], names=["term", "n", "bad"])


def _vectors(lexicon):
    def run(batches):
        for b in batches:
            x = [features(t, lexicon) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("quality"), b.column("toxic")], names=["x", "quality", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_labelled`` labelled documents, those whose ids hash lowest. The lexicon holds every
    term (a word or the beginning of one) that is surely (two standard errors) e^2 times as likely in toxic
    ones, if three of these have it. Labels that are null or whose document is missing don't count; of several
    for one id the worst counts. Without usable labels nothing is held to be unwanted."""
    import numpy as np

    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id"), "quality-sample")  # at most max_labelled ids are broadcast
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    lexicon = {}
    if 0 < bad < n:
        counts = sample.select("text", "toxic").mapInArrow(_count_terms, "term string, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter("bad >= 3")
        a, c = F.col("bad"), F.col("n") - F.col("bad")
        odds = F.log((a + 0.5) / (bad - a + 0.5)) - F.log((c + 0.5) / (n - bad - c + 0.5))
        error = F.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
        low = counts.select("term", (odds - 2 * error).alias("low")).filter("low > 2")
        lexicon = {r["term"]: float(r["low"]) for r in low.collect()}  # all such terms; the sample bounds them
    rows = sample.select("text", "quality", "toxic").mapInArrow(_vectors(lexicon), "x array<double>, quality int, toxic int").collect()  # at most max_labelled short rows
    if not rows:
        return Model({}, [[-9.0] + [0.0] * (len(FEATURES) - 1)], 0.5)
    x = np.array([r["x"] for r in rows])
    low, tox = np.array([r["quality"] == 0 for r in rows], float), np.array([r["toxic"] > 0 for r in rows], float)
    base = (np.maximum(low, tox).sum() + 0.5) / (len(rows) + 1)
    return Model(lexicon, [logistic(x, y).tolist() for y in (low, tox)], float(base))


def _strength(within: Column, between: Column) -> Column:
    """Documents' worth of prior: the spread of rates beyond that of sampling, by moments, kept in [1, 1e6]."""
    return F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.when(between > 0, within / between - 1).otherwise(1e6)))


def site_priors(scored: DataFrame) -> DataFrame:
    """From host, path and p of each document: a row per site with n, s (sum of p), host_rate (the host's
    shrunk rate) and strength (of the host's rate as its paths' prior)."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.sum("hn").alias("tn"), (F.sum("hs") / F.sum("hn")).alias("rate"), F.count("*").alias("h"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("q"))
    spread = F.col("rate") * (1 - F.col("rate"))
    # the weighted variance of the sites' rates less what sampling alone gives
    whole = whole.withColumn("kh", _strength(spread, F.col("q") / F.col("tn") - F.col("rate") * F.col("rate") - spread * F.col("h") / F.col("tn")))
    hosts = hosts.crossJoin(F.broadcast(whole.select("rate", "kh", "tn"))).withColumn("host_rate", (F.col("hs") + F.col("kh") * F.col("rate")) / (F.col("hn") + F.col("kh")))  # one row
    joined = paths.join(hosts, "host")
    inner = joined.agg((F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)) / F.sum("n")).alias("v"), (F.sum(F.col("host_rate") * (1 - F.col("host_rate"))) / F.sum("n")).alias("e"), (F.sum(F.col("n") * F.col("host_rate") * (1 - F.col("host_rate"))) / F.sum("n")).alias("w"))
    strength = inner.select(_strength(F.col("w"), F.col("v") - F.col("e")).alias("strength"))
    return joined.crossJoin(F.broadcast(strength)).select("host", "path", "n", "s", "host_rate", "strength")  # one row


def _site_columns(host_col: str, path_col: str):
    site = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(f"`{c}`").cast("string")), F.lit("n"))
    return site(host_col), site(path_col)


def _posterior(p: Column, base: float, n: Column, s: Column, rate: Column, strength: Column) -> tuple[Column, Column]:
    """(site prior without the document itself, posterior)."""
    prior = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (s - p + strength * rate) / (n - 1 + strength)))
    logit = F.log(p / (1 - p)) - math.log(base / (1 - base)) + F.log(prior / (1 - prior))
    return prior, 1 / (1 + F.exp(-logit))


def _probability(model: Model):
    kept = model.lexicon, model.heads, model.base

    @F.pandas_udf("double")
    def probability(texts):
        begin()
        m = Model(*kept)
        return texts.map(m.unwanted)

    return probability


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id_col, evidence (the classifier's probability of being unwanted),
    site_prior, posterior, keep (posterior <= threshold).

    A site is a host and a path below it; tables without paths may give another column that parts a host, as
    the default does with ``lang``. Null texts count as empty; null hosts and paths are sites of their own; null
    and repeated ids and repeated rows are scored each; other columns aren't read; an empty table gives no rows.
    Site statistics cover all rows. Texts aren't shuffled: each site's sums are joined to short rows, hot
    sites apart.
    """
    host, path = _site_columns(host_col, path_col)
    short = docs.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), _probability(model)(text_or_empty(text_col)).alias("p"))
    scored = stored(short, "quality-scores")
    prior, posterior = _posterior(F.col("p"), model.base, *(F.col(c) for c in ("n", "s", "host_rate", "strength")))
    return join_hot_apart(scored, stored(site_priors(scored), "quality-sites"), ["host", "path"]).select(F.col("id").alias(id_col), F.col("p").alias("evidence"), prior.alias("site_prior"), posterior.alias("posterior"), (posterior <= threshold).alias("keep"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns. Each text is scored once: the rows are
    stored with their scores, and the sites' sums broadcast if they are few, else joined, hot sites apart."""
    host, path = _site_columns(host_col, path_col)
    h, q, own = fresh(docs, "_host"), fresh(docs, "_path"), fresh(docs, "_p")
    scored = stored(docs.withColumns({h: host, q: path, own: _probability(model)(text_or_empty(text_col))}), "quality-scored")
    sites = stored(site_priors(scored.select(F.col(h).alias("host"), F.col(q).alias("path"), F.col(own).alias("p"))), "quality-sites")
    sums = [fresh(scored, f"_{c}") for c in ("n", "s", "host_rate", "strength")]
    renamed = sites.select(F.col("host").alias(h), F.col("path").alias(q), *[F.col(c).alias(a) for c, a in zip(("n", "s", "host_rate", "strength"), sums, strict=True)])
    n, s, rate, strength = (F.col(c) for c in sums)
    joined = scored.join(F.broadcast(renamed), [h, q]) if sites.count() <= MOST_BROADCAST else join_hot_apart(scored, renamed, [h, q])
    _, posterior = _posterior(F.col(own), model.base, n, s, rate, strength)
    return joined.filter(posterior <= threshold).select(*[f"`{c}`" for c in docs.columns])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
