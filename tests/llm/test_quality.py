import math
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwright.llm import quality


def sentence(r, n):
    return " ".join("".join(r.choices("aeioulnrst", k=r.randrange(2, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    docs, labels = [], []
    for k in range(900):
        text, good, toxic = sentence(r, r.randrange(30, 200)), 1, 0
        if k % 9 == 0:
            text, good = "SPAM!!!! ### $$$ " * 40, 0
        elif k % 9 == 1:
            words = text.split()
            for _ in range(6):
                words.insert(r.randrange(len(words)), r.choice(["zblorkish", "zblorking", "vexpat"]))
            text, toxic = " ".join(words), 1
        docs.append((k, text, f"h{k % 7}" if k % 3 else "hot", ["en", None][k % 2]))
        if k % 2:
            labels.append((k, good, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame([*labels, (10_000, 0, 1), (None, 0, 1), (3, None, 1)], "doc_id long, quality int, toxic int")


def test_held_out(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = range(0, 900, 2)
    wrong = [k for k in held if got[k].keep == (k % 9 in (0, 1))]
    assert len(wrong) <= 0.02 * len(held)
    kept = quality.keep_good(docs.withColumn("_p", F.lit(1)).withColumn("host", F.lit("x")), model)
    assert kept.columns == [*docs.columns, "_p", "host"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in got.items() if r.keep)


def test_posteriors_by_hand(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    rows = [(r.doc_id, r.source, r.lang, model.unwanted(r.text)) for r in docs.collect()]
    sums = lambda key: {k: (len(v), sum(v)) for k, v in _group(rows, key).items()}
    paths, hosts = sums(lambda r: (r[1], r[2])), sums(lambda r: r[1])
    n, rate = len(rows), sum(r[3] for r in rows) / len(rows)
    clip = lambda w, b: min(1e6, max(1.0, w / b - 1 if b > 0 else 1e6))
    spread = rate * (1 - rate)
    kh = clip(spread, sum(s * s / c for c, s in hosts.values()) / n - rate * rate - spread * len(hosts) / n)
    shrunk = {h: (s + kh * rate) / (c + kh) for h, (c, s) in hosts.items()}
    v = sum(c * (s / c - hosts[h][1] / hosts[h][0]) ** 2 for (h, _), (c, s) in paths.items()) / n
    e = sum(shrunk[h] * (1 - shrunk[h]) for h, _ in paths) / n
    w = sum(c * shrunk[h] * (1 - shrunk[h]) for (h, _), (c, _) in paths.items()) / n
    k = clip(w, v - e)
    for i, h, q, p in rows:
        c, s = paths[h, q]
        prior = (s - p + k * shrunk[h]) / (c - 1 + k)
        z = math.log(p / (1 - p)) - math.log(model.base / (1 - model.base)) + math.log(prior / (1 - prior))
        assert got[i].site_prior == pytest.approx(prior, abs=1e-9) and got[i].posterior == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def _group(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r[3])
    return out


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = [("big", "a", 0.9)] * 200 + [("big", "b", 0.9)] * 200 + [("clean", "a", 0.05)] * 400 + [("new", "a", 0.9)]
    sites = {r.host: r for r in quality.site_priors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    rate = sum(r[2] for r in rows) / len(rows)
    assert abs(sites["big"].host_rate - 0.9) < 0.01 and rate < sites["new"].host_rate < 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None), (1, "", "a", None), (1, "", "a", None), (2, "w " * 50_000, None, "x")], "doc_id long, text string, source string, lang string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, no_labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 4 and all(r.keep and math.isfinite(r.posterior) for r in got), "nothing is rejected without labels"
    assert quality.keep_good(docs, model).count() == 4
    assert quality.score(docs.limit(0), model).collect() == [] == quality.keep_good(docs.limit(0), model).collect()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_on_the_test_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter("doc_id % 3 > 0")
    got = quality.score(docs, quality.fit(docs, train)).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r.keep for r in got if r.quality and not r.toxic]
    low = [not r.keep for r in got if not r.quality]
    assert sum(clean) / len(clean) > 0.97 and sum(low) / len(low) > 0.9


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no test tables")
def test_toxic_documents_go(spark):
    """Held out: of documents that are toxic but of good quality most go, of clean ones next to none."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 3 = 0")
    got = quality.score(docs.join(held, "doc_id", "left_semi"), quality.fit(docs, labels.filter("doc_id % 3 > 0"))).join(held, "doc_id").collect()
    toxic = [not r.keep for r in got if r.toxic and r.quality]
    clean = [r.keep for r in got if r.quality and not r.toxic]
    assert len(toxic) > 50 and sum(toxic) / len(toxic) > 0.8 and sum(clean) / len(clean) > 0.99
