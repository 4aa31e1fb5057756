"""Ranked search against counting by force."""

import math
import re
from collections import Counter

import pytest

from seriesloom.llm import search
from seriesloom.llm.search import TERM_PATTERN

DOCS = [
    (1, "The cat, the dog; the CAT"), (2, None), (3, ""), (4, "..."), (5, "cat"), (6, "cat"), (6, "cat"), (None, "cat"), (7, "catalog scat cat_cat"),
    (8, "caf\u00e9 \u0416\u00a0x 12 dog dog dog"), (9, "a" * 3000 + " dog " + "the " * 900), (10, "nothing of it"), (11, "D\x85OG dog"),
]
ITEMS = [(1, "cat dog"), (1, "cat dog"), (1, "the the cat"), (2, None), (3, "!!"), (4, "caf\u00c9 caf\u00e9 \u0436 \u0416\u00a0x"), (None, "dog"), (5, "absent"), (6, "cat 12")]


def terms(text):
    return re.findall(TERM_PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_force(docs, items, top):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    number, total = len(own), sum(sum(c.values()) for _, c in own)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in own:
            m = 100 - 25 + (25 * sum(c.values()) * number) // total
            score = 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * number + 2) / (2 * sum(t in x for _, x in own) + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) if c[t] else 0
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:top])]
    return Counter(out)


@pytest.mark.parametrize(("top", "room", "scan"), [(20, 1 << 20, 1 << 20), (2, 30, 64)])
def test_search_equals_counting_by_force(spark, monkeypatch, top, room, scan):
    monkeypatch.setattr(search, "SCAN_BYTES", scan)
    monkeypatch.setattr(search, "HELD", 3)
    monkeypatch.setattr(search, "SCORED", 2)
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in DOCS], "doc_id long, text string, rank string, n string").repartition(3)
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, doc_id string")
    found = search.search(docs, items, top, automaton_bytes=room).drop("text_key")
    assert Counter(map(tuple, found.collect())) == by_force(DOCS, ITEMS, top)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
