"""Language, toxicity and license operators: held-out accuracy, model properties, brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import language, licenses, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def models(docs):
    return language.fit_on_folds(docs)


def test_probabilities_sum_to_one(models):
    every = np.arange(1 << 16, dtype=np.uint64)
    for before in ("th", "q一", "\0\0"):
        context = (np.uint64(ord(before[0])) << np.uint64(32)) | (np.uint64(ord(before[1])) << np.uint64(16))
        p = np.exp(models.log_probs(context | every).astype(float))
        seen = np.isin(every, [k for k in range(1 << 16) if next(models.each()).tables[0].find(np.array([k], np.uint64))[1][0]])
        assert np.allclose(p[seen].sum(axis=0) + p[~seen][:1].sum(axis=0), 1, atol=1e-3)


def test_language_held_out(spark, docs, models):
    found = language.identify(docs, models, ["doc_id", "lang"]).where(language.fold("doc_id") == 2).toPandas()
    assert len(found) > 200 and (found.lang == found.lang_pred).mean() >= 0.99
    assert found.accepted.mean() >= 0.99 and found.score.between(0, 1).all()


def test_language_of_odd_texts(spark, docs, models, monkeypatch):
    english = docs.where("lang = 'en' AND length(text) > 2000").first().text
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "😀😀"), (5, english), (6, "中文字符" * 30), (None, english), (7, (english + " ") * 3)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, score string")
    found = {r.doc_id: r for r in language.identify(df, models, ["doc_id", "score"]).collect()}
    assert all(found[k].lang_pred == "und" and found[k].score_ == 0 and not found[k].accepted for k in (1, 2, 3, 4))
    assert found[5].lang_pred == "en" and found[5].accepted and found[None].lang_pred == "en" and found[5].score == "kept"
    assert not found[6].accepted
    monkeypatch.setattr(language, "SEGMENT", 1000)
    again = {r.doc_id: r for r in language.identify(df, models, ["doc_id"]).collect()}
    assert again[7].lang_pred == "en" and abs(again[7].cross_entropy - found[7].cross_entropy) < 0.05
    assert language.keep_accepted(df, models).columns == df.columns
    assert {r.doc_id for r in language.keep_accepted(df, models).collect()} == {5, 7, None}


def test_language_without_labels(spark, docs):
    none = language.fit_on_folds(docs.limit(0))
    assert {(r.lang_pred, r.accepted) for r in language.identify(docs, none, ["doc_id"]).collect()} == {("und", True)}
    assert language.identify(docs.limit(0), none, ["doc_id"]).count() == 0


def test_gram_counts_are_exact(spark):
    df = spark.createDataFrame([("aab", "x"), ("AAB b1b", "x"), ("aab", None), (None, "x"), ("aab", "y")], "text string, lang string")
    counts = {(r.lang, r.gram): r.n for r in language.count_grams(df, "text", "lang").collect()}
    pack = lambda s: sum(ord(c) << (16 * k) for k, c in enumerate(reversed(s)))
    assert counts["x", pack("\0\0\0a")] == 2 and counts["x", pack("\0aab")] == 2 and counts["y", pack("\0aab")] == 1
    assert counts["x", pack("aab\0")] == 1 and counts["x", pack("b\0b\0")] == 1
    assert sum(n for (lang, _), n in counts.items() if lang == "x") == 10


def test_machine_learns_pairs():
    rng = np.random.default_rng(0)
    both = rng.random((3000, 2)) < 0.5
    toxic = (both[:, 0] & both[:, 1]) | (~both[:, 0] & ~both[:, 1])  # no additive weights can tell
    x = np.concatenate([both, ~both], axis=1)
    row, found = np.nonzero(x)
    m = toxicity.train(np.arange(4, dtype=np.uint64), row, found * len(toxicity.LEVELS), toxic.astype(float))
    score = m.scores(row, found * len(toxicity.LEVELS), len(toxic))
    assert ((score >= 0.5) == toxic).mean() > 0.95


def test_toxicity_held_out(spark):
    found = toxicity.op10_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = found.where("held_out").join(labels, "doc_id").toPandas()
    assert held.predicted[held.toxic == 1].mean() >= 0.85
    assert held.predicted[held.toxic == 0].mean() <= 0.01
    assert found.count() == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()


def test_toxicity_of_odd_tables(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    df = spark.createDataFrame([(1, "bad"), (1, None), (None, "bad"), (2, ""), (3, "x " * 10_000)], "doc_id long, text string")
    m = toxicity.fit(df, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, m, ["doc_id"]).collect())
    empty = toxicity.fit(df.limit(0), labels.limit(0))
    found = toxicity.score(df.withColumn("score", F.lit("a")), empty, ["doc_id", "score"])
    assert found.columns == ["doc_id", "score", "score_"] and found.count() == 5
    assert toxicity.score(df.limit(0), empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("licensed under the GNU General Public License, version 3", "gpl-3.0"), ("GPLv2 or later", "gpl-2.0"), ("LGPL-2.1-only", "lgpl-2.1"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("see http://www.apache.org/licenses/LICENSE-2.0.html", "apache-2"),
        ("Mozilla Public License 2.0", "mpl-2.0"), ("CC BY-SA 4.0", "cc-by-sa"), ("Eclipse Public License v2.0", "epl-2.0"),
        ("This is free and unencumbered software released into the public domain", "unlicense"), ("All rights reserved.", "proprietary"),
    ],
)
def test_signatures(text, label):
    found = licenses.detections(licenses.canonical(f"First words. {text} Last."), licenses.rules())
    assert label in {d[0] for d in found}


def test_rules_and_suppression():
    rules = licenses.rules()
    assert len(rules) > 200
    assert licenses.detections(licenses.canonical("nothing of the kind in these committed words"), rules) == []
    found = licenses.detections(licenses.canonical("under the terms of the GNU Lesser General Public License version 2.1"), rules)
    assert [d[0] for d in found] == ["lgpl-2.1"]  # not the titles within it


def test_license_places_equal_brute_force(spark, docs):
    base = licenses.BASE
    rows = [(k, t) for k, t in enumerate([None, "", "cc", "CC-BY-NC cc by nc nc; under\nthe MIT license", "éapache license version 2", "under the mit licenses", "A_under the mit license" * 2])]
    rows += [(100 + r.doc_id, r.text) for r in docs.where("doc_id < 300 OR lower(text) LIKE '%licen%'").collect()] + [(None, "under the mit license")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base int")
    found = {r.doc_id: r for r in licenses.scan(df, ["doc_id", "base"]).collect()}
    for key, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((k, x) for p, x in base.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert found[key].n_words == len(words) and [(b.word, b.label) for b in found[key].base_] == places
    assert licenses.scan(df.limit(0), ["doc_id"]).count() == 0
