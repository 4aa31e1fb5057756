"""The pipeline's stages against what each may change."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_shingles import roots

from seriesloom.llm import decontam, language
from seriesloom.llm.queries import ORACLES, QUERIES
from seriesloom.llm.tables import saved


@pytest.fixture(scope="module")
def steps(spark):
    sf = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(saved(stage(spark, docs[-1], sf), name))
    return sf, docs


def test_stages_in_order(steps):
    sf, docs = steps
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    assert all(d.columns == docs[0].columns for d in docs[:5])


def test_each_decision_takes_effect(spark, steps):
    sf, docs = steps
    accepted = language.identify(docs[0], language.fit_on_folds(docs[0]), ["doc_id"]).where("accepted")
    assert {r.doc_id for r in accepted.collect()} == {r.doc_id for r in docs[1].select("doc_id").collect()}
    assert docs[2].count() == docs[1].count() and docs[2].where(F.length("text") != F.col("n_chars")).count() == 0
    rows = sorted(docs[2].select("doc_id", "text").collect())
    assert {r.doc_id for r in docs[3].collect()} == {rows[k].doc_id for k in set(roots([r.text for r in rows]))}
    bad = {r.doc_id for r in decontam.contaminated(docs[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert bad and {r.doc_id for r in docs[4].collect()} == {r.doc_id for r in docs[3].collect()} - bad
    assert {r.doc_id for r in docs[5].collect()} == {r.doc_id for r in docs[4].collect()}


def test_run_and_registration(spark, steps):
    sf, docs = steps
    names = ["doc_id", "start", "length", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first() == docs[5].agg(F.sum("length")).first()
    assert set(names) < set(docs[5].columns)
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
