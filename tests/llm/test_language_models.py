"""Complete Kneser-Ney models: against a plain computation, many languages in blocks, singletons kept."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from seriesloom.llm import language

ORDER = language.ORDER


def plain_model(texts, alphabet):
    """log P(symbol | three before) by the recursion itself, over dictionaries."""
    counts = [None] * ORDER
    top = Counter()
    for text in texts:
        line = ["\0"] * (ORDER - 1) + symbols_of(text)
        top.update(tuple(line[k - ORDER + 1 : k + 1]) for k in range(ORDER - 1, len(line)))
    counts[ORDER - 1] = top
    for low in range(ORDER - 1, 0, -1):
        counts[low - 1] = Counter(g[1:] for g in counts[low])
    totals, kinds, discounts = [], [], []
    for c in counts:
        total, kind = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            kind[g[:-1]] += 1
        n1, n2 = (sum(n == k for n in c.values()) for k in (1, 2))
        totals.append(total)
        kinds.append(kind)
        discounts.append(min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5)

    def p(gram):
        n = len(gram)
        lower = 1 / alphabet if n == 1 else p(gram[1:])
        total = totals[n - 1][gram[:-1]]
        if not total:
            return lower
        count, d = counts[n - 1][gram], discounts[n - 1]
        return max(count - d, 0) / total + d * kinds[n - 1][gram[:-1]] / total * lower

    return p, counts


def symbols_of(text):
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != "\0":
            out.append("\0")
    return out


TEXTS = {"aa": ["banana bandana", "an ant", "b"], "bb": ["xyz xylo", "banana xx"], "cc": ["zzzz"]}


@pytest.mark.parametrize("cells", [language.BLOCK_CELLS, 1])
def test_models_equal_the_recursion(spark, monkeypatch, cells):
    monkeypatch.setattr(language, "BLOCK_CELLS", cells)
    rows = [(t, name) for name, own in TEXTS.items() for t in own]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    models = language.fit(df, df)
    assert models.languages == ["aa", "bb", "cc"] and len(models.blocks) == (1 if cells > 1 else 3)
    alphabet = len({s for t, _ in rows for s in symbols_of(t)}) + 1
    pack = lambda g: np.uint64(sum(ord(c) << (16 * k) for k, c in enumerate(reversed(g))))
    grams = {("\0", *g) for g in ("ban", "ana", "xyz", "qqq", "nda", "zzz", "\0xy", "a\0b", "anx", "zzb") for g in (tuple(g),)}
    grams |= {tuple(g) for g in ("bana", "anan", "zzzz", "xylo", "banx", "qban", "zz\0q", "a\0xy")}
    found = models.log_probs(np.array([pack(g) for g in grams], np.uint64))
    for k, (name, own) in enumerate(TEXTS.items()):
        p, counts = plain_model(own, alphabet)
        assert any(n == 1 for n in counts[ORDER - 1].values())
        for g, logs in zip(grams, found, strict=True):
            assert logs[k] == pytest.approx(math.log(p(g)), abs=5e-6)


def test_seventy_languages_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(11)
    names = [f"l{k:02d}" for k in range(70)]
    letters = [rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:9] for _ in names]
    text = lambda k: " ".join("".join(rng.choice(letters[k], int(rng.integers(3, 8)), p=np.arange(9, 0, -1) / 45)) for _ in range(120))
    rows = [(100 * k + i, text(k), name) for k, name in enumerate(names) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "BLOCK_CELLS", 60_000)
    models = language.fit(df, df)
    assert models.languages == names and len(models.blocks) > 5
    fresh = spark.createDataFrame([(k, text(k), name) for k, name in enumerate(names)], "doc_id long, text string, lang string")
    found = language.identify(fresh, models, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.97
    monkeypatch.setattr(language, "HELD_SYMBOLS", 10)
    again = {r.doc_id: r.cross_entropy for r in language.identify(fresh, models, ["doc_id"]).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.cross_entropy, abs=1e-9) for r in found)


def test_blocks_hold_all_languages():
    sizes = [("c", 5), ("a", 4), ("b", 100), ("d", 1), ("e", 1)]
    blocks = language.blocks_of(sizes, 24)
    assert [x for b in blocks for x in b] == list("abcde") and blocks == [["a"], ["b"], ["c", "d", "e"]]
    held = defaultdict(int, sizes)
    assert all(len(b) == 1 or sum(held[x] for x in b) * len(b) <= 24 for b in blocks)
