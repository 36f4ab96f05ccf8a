"""Registered corpus queries against their SQL, and the pipeline as a whole."""

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fieldcast.llm import decontamination, pii, quality, simhash
from fieldcast.llm.queries import ORACLE, REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), name, REGISTRY[name], ORACLE[name], SF) == ""


def test_all_are_registered():
    assert {*REGISTRY, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, sf = docs.columns, "/root/testdata/sf0.01"
    verdict = {r.doc_id: r.kept for r in quality.op9_quality(spark, sf).collect()}
    now = corpus_pipeline.cut(corpus_pipeline.quality_rules(spark, docs, sf))
    assert now.columns == columns and {r.doc_id for r in now.select("doc_id").collect()} == {i for i, k in verdict.items() if k}
    classes = {}
    for r in simhash.near_duplicates(now).collect():
        classes.setdefault(r.component_id, []).append(r.doc_id)
    one = corpus_pipeline.cut(corpus_pipeline.near_duplicates(spark, now, sf))
    assert one.columns == columns and sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(min(v) for v in classes.values())
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    judged, name = decontamination.annotate(one, items)
    bad = {r.doc_id for r in judged.where(F.col(name)["contaminated"]).collect()}
    clean = corpus_pipeline.cut(corpus_pipeline.decontaminated(spark, one, sf))
    assert bad and clean.columns == columns and clean.count() == one.count() - len(bad)
    private = corpus_pipeline.cut(corpus_pipeline.personal_data(spark, clean, sf))
    assert private.columns == columns and private.count() == clean.count()
    rest = [r.text for r in private.select("text").collect()]
    assert not any(pii.base_spans(t) for t in rest) and any("[EMAIL]" in t for t in rest)
    assert private.where(F.col("n_chars") != F.length("text")).count() == 0
    packed = corpus_pipeline.packed(spark, private, sf)
    assert packed.select("doc_id").distinct().count() == private.count()


def test_pipeline_takes_odd_tables(spark):
    good = " ".join(f"word{i % 97} text{i % 89}" for i in range(80))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, good, "en", "s", 3), (2, good, "en", "s", 3), (None, good + " x", None, None, None)]
    docs = spark.createDataFrame([(*r, "extra", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, kept int")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.cut(stage(spark, now, SF))
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() > 0) == (given is docs)
