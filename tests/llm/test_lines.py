"""Boilerplate lines by length: the stage drops repeated long lines, and keeps short ones that chance repeats."""

import corpus_pipeline

from seriesloom.llm import lines


def test_long_lines_go_at_a_smaller_share(spark):
    passage, sentence, word = "x" * 60 + " and the same words once more on page after page of it", "Subscribe to our newsletter.", "Les."
    rows = []
    for k in range(1200):
        some = [" ".join([f"story number {k} of this host"] * 8)] + [passage] * (k < 6) + [sentence] * (k % 100 == 1) + [word] * (k % 20 == 2)
        rows.append((k, "\n".join(some), "a", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = corpus_pipeline.lines(spark, df, "")
    whole = "\n".join(r.text for r in found.collect())
    assert found.count() == 1200 and passage not in whole and sentence not in whole and whole.count(word) == 60
    assert all(f"story number {k} of this host" in whole for k in range(1200))
    plain = "\n".join(r.text for r in lines.drop_site_lines(df).collect())  # one ratio for all lines
    assert plain.count(passage) == 6 and plain.count(sentence) == 12


def test_near_copies_of_a_page_keep_their_content(spark):
    body = [f"paragraph {j} of an article that six pages hold with another date each, " + "y" * 60 for j in range(5)]
    rows = [(k, "\n".join([f"date {k}", *body] if k < 6 else [f"story number {k} of this host"]), "a", 0) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert {(r.doc_id, r.text) for r in corpus_pipeline.lines(spark, df, "").collect()} == {r[:2] for r in rows}
