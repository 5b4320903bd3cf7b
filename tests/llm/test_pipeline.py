from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import mixing, quality, secrets
from fathomline.llm import queries as Q

from .test_data_operators import check_packing
from .test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in quality.rate_quality(docs, public_tokenizers.path("piece_bpe_32k.model")).where("kept").collect()}
    a = stages["quality rules"](spark, docs, SF)
    assert {r.doc_id for r in a.collect()} == kept and a.columns == docs.columns
    b = stages["near-dedup"](spark, a, SF)
    want = {i for i, (_, c) in brute([(r.doc_id, r.text) for r in a.collect()]).items() if i == c}
    assert {r.doc_id for r in b.collect()} == want and b.columns == docs.columns
    c = stages["secret scans"](spark, b, SF).collect()
    assert len(c) == len(want) and not any(secrets.base_spans(r.text) for r in c)
    assert all(r.n_chars == len(r.text) for r in c)
    masked = spark.createDataFrame(c, docs.schema)
    d = stages["source mixing"](spark, masked, SF)
    times = {r.doc_id: r.copies for r in mixing.mix(masked).collect() if r.copies}
    assert Counter(r.doc_id for r in d.collect()) == times and d.columns == docs.columns
    rows = stages["packing"](spark, d, SF).collect()
    check_packing([(r.doc_id, r.text) for r in d.collect()], rows)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0 and out.count() > 100


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 11))
    assert set(Q.SQL) <= set(Q.QUERIES)


def test_pipeline_stages_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (None, "words " * 3, None, None, 5), (2, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, d, SF).collect()


def clashing(spark, rows):
    """Rows (doc_id, text, source) with columns named like those that operators make."""
    full = [(i, t, "en", s, None if t is None else len(t), 1, "size?", 2.5, 7, "band", "spans", True) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size int, target string, source_size double, copies long, band string, spans string, kept boolean")


def test_stages_keep_extra_columns_with_clashing_names(spark):
    text = "the river ran past the old mill and down to the town where people met"
    docs = clashing(spark, [(i, f"{text} number {i} {'and more words of it ' + str(i)}", f"s{i % 2}") for i in range(12)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        assert rows and stage(spark, docs, SF).columns == docs.columns, name
        assert {(r.size, r.target, r.source_size, r["copies"], r.band, r.spans, r.kept) for r in rows} == {(1, "size?", 2.5, 7, "band", "spans", True)}


def test_near_dedup_of_repeated_rows(spark):
    words = [f"w{i}" for i in range(40)]
    one, two = " ".join(words), " ".join(reversed(words))
    docs = clashing(spark, [(5, one, "a"), (5, one, "a"), (6, two, "a"), (6, "b " + two, "a"), (7, one, "b"), (8, None, "a"), (8, "", "a"), (None, one, "a"), (None, one, "a")])
    kept = sorted(((r.doc_id or 0), r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert kept == [(0, one), (0, one), (5, one), (6, min(two, "b " + two)), (8, "")]


def test_long_texts_and_ties(spark):
    long_ = " ".join(f"word{i % 5000} flows{i % 77}" for i in range(120_000))
    docs = clashing(spark, [(1, long_, "a"), (2, long_, "a"), (3, "x" * 300_000, "a"), (4, "password = " + "k3" * 100_000, None)])
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        if name == "near-dedup":
            assert sorted(r.doc_id for r in rows) == [1, 3, 4]
        if name == "secret scans":
            assert [r.text for r in rows if r.doc_id == 4] == ["<SECRET>"]
        if name == "packing":
            check_packing([(r.doc_id, r.text) for r in docs.collect()], rows)
