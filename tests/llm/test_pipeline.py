import os
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
import test_line_templates  # noqa: E402
import test_ngram_join  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_each_stage_against_brute_force(spark):
    from loomwright.llm.quality import fit, score
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "packing"]

    good = stages["quality"](spark, docs, SF).cache()
    kept = {r.doc_id for r in score(docs, fit(docs, labels)).collect() if r.keep}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    clean = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()}
    assert len(clean & kept) > 0.97 * len(clean)

    lines = stages["line_dedup"](spark, good, SF).cache()
    want = test_line_templates.brute([(r.doc_id, r.text) for r in good.collect()], 3, 10, 0.6)
    assert lines.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == Counter((i, t) for i, t, _, gone in want if not gone or t.strip())
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = stages["near_duplicates"](spark, lines, SF).cache()
    groups = test_ngram_join.brute([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in near.collect()} == {c if n else i for i, n, c in groups} and near.columns == docs.columns

    pieces = stages["packing"](spark, near, SF).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in near.collect()}
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
        assert p.doc_tokens == want[p.doc_id]
    assert got == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) and sum(want.values()) == max(p.sequence_id * 2048 + p.offset + p.length for p in pieces)


def test_nulls_empties_ties_and_repeats(spark, tmp_path):
    """Each stage gives its defined result on rows that tables shouldn't have, and on none at all."""
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
    footer = "All rights reserved by somebody"
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + " end", "en", "a", 5), (None, text, None, None, None), (3, None, "en", None, 0), (4, "", None, "a", 0), (5, " \n\t ", "en", "a", 4), (None, None, None, None, None)]
    rows += [(k, f"line of{chr(97 + k % 26)} its{chr(97 + k // 26)} own\n{footer}", "de", "hot", 9) for k in range(100, 140)] + [(200, f"{footer}\n\t", "de", "hot", 9)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _n int, label string"
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], kind).repartition(3)
    spark.createDataFrame([(1, 1, 0), (100, 1, 0), (None, 0, 1), (101, None, 1), (102, 0, None), (999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    sf = str(tmp_path)

    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns and good.count() == len(rows), "no usable label is bad"

    lines = stages["line_dedup"](spark, docs, sf)
    out = Counter((r.doc_id, r.text, r.n_chars) for r in lines.collect())
    assert lines.columns == docs.columns and (200, f"{footer}\n\t", 9) not in out and not any(i == 200 for i, *_ in out), "nothing but white space is left"
    assert sum(footer in (t or "") for _, t, _ in out) == 1 and (100, rows[8][1], 9) in out
    assert out[1, text, 5] == 2 and out[None, text, None] == 1 and out[3, None, 0] == out[5, " \n\t ", 4] == out[None, None, None] == 1

    near = stages["near_duplicates"](spark, docs, sf)
    ids = Counter(r.doc_id for r in near.collect())
    assert near.columns == docs.columns and ids[1] == 1 and ids[2] == 0 and ids[None] == 1 and ids[3] == ids[4] == ids[5] == 1

    pieces = stages["packing"](spark, docs, sf).collect()
    assert sum(p.start == 0 for p in pieces) == len(rows) and sum(p.length for p in pieces) == max(p.sequence_id * 2048 + p.offset + p.length for p in pieces)

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == [], name
