"""SimHash groups, vector links, line dedup and decontamination against brute force."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from seriesloom.llm import decontam, lines, simhash, tables, vectors
from seriesloom.llm.blocks import Powers, byte_blocks


def union(n, pairs):
    at = list(range(n))

    def root(k):
        while at[k] != k:
            at[k] = at[at[k]]
            k = at[k]
        return k

    for a, b in pairs:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) > len(values)) if values else 0


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}é" if k % 7 == 0 else f"Word{k}" for k in range(400)])
    out = [None, "", "  \n", "one", "Two words", "a\x0bb\x0cc d", "  x y z"]
    for _ in range(60):
        base = list(rng.choice(words, int(rng.integers(3, 300))))
        out.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            copy = list(base)
            copy[int(rng.integers(len(copy)))] = "changed"
            out.append("\t".join(copy) if rng.random() < 0.3 else " ".join(copy))
    big = list(rng.choice(words, 2000))
    for k in range(0, 2000, 9):  # a crowd of near copies, and some copies
        out += [" ".join(big[:k] + ["changed"] + big[k + 1 :])] * (2 if k % 5 == 0 else 1)
    return out


@pytest.mark.parametrize("cell", [simhash.CELL, 16])
def test_simhash_groups_equal_brute_force(spark, texts, cell, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 5_000)  # long texts are read in pieces
    df = spark.createDataFrame([(k + 5, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(3)
    found = {r.doc_id: r for r in simhash.simhash_groups(df, cell=cell).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [found[k + 5].fp % 2**64 for k in range(len(texts))] == prints
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert [found[k + 5].component_id for k in range(len(texts))] == [k + 5 for k in union(len(texts), pairs)]


def test_distance_of_embeddings_is_a_bound():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64)
    counts = lambda x: [[(int(v) >> (2 * k) & 3).bit_count() for k in range(32)] for v in x]
    plain = np.abs(np.array(counts(a)) - np.array(counts(b))).sum(axis=1)
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) == plain).all()
    assert (plain <= np.bitwise_count(a ^ b)).all()


def test_one_of_each_group_keeps_one_row(spark):
    rows = [(3, "a b c d e", 1), (3, "a b c d e", 2), (1, "a b c d e", 3), (None, "a b c d e", 4), (3, "other text that is not near", 5), (None, None, 6), (9, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_key int")
    assert {r.text_key for r in simhash.one_of_each_group(df).collect()} == {3, 5, 7}
    twice = spark.createDataFrame([(3, "a b c", 1), (3, "a b c", 1), (4, "a b c", 2)], df.schema)
    assert [tuple(r) for r in simhash.one_of_each_group(twice).collect()] == [(3, "a b c", 1)]
    assert simhash.one_of_each_group(df.limit(0)).columns == df.columns
    assert simhash.one_of_each_group(df.limit(0)).count() == 0


def test_components_of_chains_hubs_and_nothing(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 400)] + [(7, 7), (399, 100)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    found = {r.node: r.component for r in tables.components(df).collect()}
    assert set(found.values()) == {5}
    assert set(found) == {*range(100, 161), *range(200, 400)}
    assert tables.components(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 24))
    rows = []
    for k, b in enumerate(base):
        b = b / np.linalg.norm(b)
        for e in (0, 0, 0.2, 0.38, 0.4):
            d = rng.standard_normal(24)
            d -= d @ b * b
            rows.append((3.5 * (b + e * d / np.linalg.norm(d)), k % 3))
    rows += [(base[0] + rng.standard_normal(24) * 0.05, 0) for _ in range(300)]
    out = [(10 + k, [float(np.float32(x)) for x in v], label) for k, (v, label) in enumerate(rows)]
    odd = [[0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [], None, [1.0] * 23]
    out += [(2000 + k, v, 0) for k, v in enumerate(odd)]
    return out + [(3000, out[0][1], None), (3001, [1e-30 * x for x in out[5][1]], 1), (3002, out[0][1], 1)]


@pytest.mark.parametrize(("large", "sample"), [(vectors.LARGE_LEAF, vectors.FIT_ROWS), (60, vectors.FIT_ROWS), (vectors.LARGE_LEAF, 60)])
def test_near_vectors_equal_brute_force(spark, vector_rows, large, sample, monkeypatch):
    monkeypatch.setattr(vectors, "FIT_ROWS", sample)
    df = spark.createDataFrame([(*r, "x") for r in vector_rows], "vec_id long, embedding array<double>, label int, node string").repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, leaf=64, large=large).collect()}
    good = [r for r in vector_rows if r[2] is not None and r[1] and len(r[1]) == 24 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([np.array(r[1]) / np.abs(r[1]).max() for r in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in good])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    roots = union(len(good), np.argwhere(near).tolist())
    expected = {r[0]: (int(near[k].sum()), good[roots[k]][0], roots[k] == k) for k, r in enumerate(good)}
    assert len(found) == len(vector_rows)
    assert all(found[r[0]] == (0, r[0], True) for r in vector_rows if r[0] not in expected)
    links, there = sum(v[0] for k, v in found.items()), sum(v[0] for v in expected.values())
    assert 0.999 * there <= links <= there
    assert sum(found[k] == v for k, v in expected.items()) >= 0.99 * len(expected)


def test_leaves_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FIT_ROWS", 100)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 16))
    rows = [("a" if k < 3000 else "b", k, 1, v.tolist()) for k, v in enumerate(x)]
    classes = spark.createDataFrame(rows, "label string, node long, n long, vector array<double>").repartition(3)
    trees = vectors.fit_forest(classes, 16, 4000, 0.93, 2, 50)
    for tree in trees:
        row, leaf = tree.leaves_of(x / np.linalg.norm(x, axis=1)[:, None])
        assert set(row.tolist()) == set(range(4000)) and set(leaf.tolist()) == set(range(tree.leaves))
        assert max(np.bincount(leaf[row < 3000]).max(), np.bincount(leaf[row >= 3000]).max()) <= 100


def test_near_vectors_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (6, [1.0, 0.1], 1)]
    found = sorted(map(str, vectors.near_vectors(spark.createDataFrame(rows, schema)).collect()))
    assert found == sorted(
        ["Row(vec_id=None, n_links=0, component_id=None, kept=False)"] + ["Row(vec_id=4, n_links=2, component_id=4, kept=True)"] * 2
        + ["Row(vec_id=6, n_links=2, component_id=4, kept=False)"]
    )


def test_site_lines(spark):
    menu = "Home | About"
    rows = [(k, f" {menu} \nstory {k}\n\nend {k}", "a", k) for k in range(8)] + [(20 + k, menu, "b", k) for k in range(3)]
    rows += [(30, None, "a", 0), (31, "", "a", 0), (32, menu, None, 0), (33, menu + "\n" + menu, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, flags long")
    found = {r.doc_id: r for r in lines.drop_site_lines(df, ratio=0.5, dropped_col="gone").collect()}
    assert found[3].text == "story 3\n\nend 3" and found[3].gone == 1 and found[3].flags == 3
    assert found[20].text == menu and found[32].text == menu and found[30].text is None
    assert found[33].text == "" and found[33].gone == 2 and found[31].text == ""
    copies = spark.createDataFrame([(k, "same\ntext", "a", 0) for k in range(50)], df.schema)
    assert {r.text for r in lines.drop_site_lines(copies).collect()} == {"same\ntext"}  # one page, however often it is copied
    assert lines.drop_site_lines(df.limit(0)).columns == df.columns


def test_site_lines_joined_when_too_many_to_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"menu\nstory {k}", "a") for k in range(30)], "doc_id long, text string, source string")
    whole = sorted(map(str, lines.drop_site_lines(df).collect()))
    monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    assert sorted(map(str, lines.drop_site_lines(df).collect())) == whole


ITEM = "A train leaves Paris at 9 and covers 300 km before it meets Anna in Lyon after 3 hours. How far did it go each hour?"


def test_templates_find_changed_questions_only(spark):
    new = "A train leaves Madrid at 7 and covers 450 km before it meets Boris in Toledo after 5 hours. How far did it go each hour?"
    mixed = new.replace("Toledo", "Madrid").replace("7", "5")  # two names and two numbers that differ in the item become equal
    rows = [
        (1, f"Before. {ITEM} After."), (2, f"Before it.\n\n{new.replace(' ', '  ')} After."), (3, f"Intro. {mixed}"), (4, " ".join(ITEM.split()[:10])),
        (5, None), (6, ""), (7, "A train leaves."), (None, ITEM), (8, "x " * 50_000 + ". " + ITEM), (8, "again"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, h int")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (None, "A train leaves."), (13, "9 10 11")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.exact for r in decontam.contaminated(df, items).collect()}
    assert found == {(1, 10): True, (2, 10): False, (8, 10): True}
    left = decontam.drop_contaminated(df, items)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [3, 4, 5, 6, 7, 8] and left.columns == df.columns
    assert decontam.contaminated(df, items.limit(0)).count() == 0
    assert decontam.contaminated(df.limit(0), items).count() == 0


def test_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Tom buys 7 more apples. How many apples does Tom have now?"
    text = {
        1: "Anna has 3 apples. Anna buys 8 more apples. How many apples does Anna have now?",
        2: "Anna has 3 apples. Tom buys 8 more apples. How many apples does Anna have now?",  # two people
        3: "Anna has 3 apples. Ben buys 8 more apples. How many apples does Tom have now?",
        4: item, 5: "Anna has 3 pears. She ate 8 more of them. How many apples does Anna have now?", 6: item.lower(),
    }
    passage = "The dog ran to the old house. The cat saw it and left the garden. A man came by and took the cat home with him"
    text |= {7: passage.replace("The dog", "A dog"), 8: passage}
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, passage)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.exact for r in decontam.contaminated(df, items).collect()}
    assert found == {(1, 10): False, (4, 10): True, (7, 11): True, (8, 11): True}


def test_long_texts_in_pieces_have_the_same_windows(monkeypatch):
    rng = np.random.default_rng(5)
    words = np.array(["Paris", "the", "12", "km", "a.", "Anna", "x9", "3.5", "hours", "é", "left!", "\n", "of"])
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 4, 5, 6, 7, 40, 400)] + ["w" * 300 + " a b c d e f", "a " + "w" * 500]

    def found():
        out = {}
        for row, t, before, had in decontam.template_blocks(pa.array(texts), Powers()):
            for k in np.flatnonzero(t.window >= had).tolist():
                key = (row + int(t.row[k]), int(t.position[k]) + before, int(t.form[k]))
                assert key not in out
                out[key] = (int(t.hash[k]), bool(t.plain[k]), t.slots(k))
        return out

    whole = found()
    for limit in (30, 64, 150):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", limit)
        monkeypatch.setattr(decontam, "byte_blocks", lambda column, limit=limit: byte_blocks(column, limit))
        assert found() == whole


def test_windows_of_a_batch_are_made_in_small_parts():
    rng = np.random.default_rng(6)
    words = np.array(["Paris", "the", "12", "km", "a.", "Anna", "left!", "of"])
    texts = pa.array([" ".join(rng.choice(words, 900)) for _ in range(800)])  # 3 MB
    powers, n = Powers(), 0
    tracemalloc.start()
    for _, t, _, _ in decontam.template_blocks(texts, powers):
        n += int((t.form == 0).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 800 * 896
    assert peak < 50e6


def test_all_planted_items_are_found(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = docs.alias("d").join(items.alias("i"), F.expr("contains(d.text, i.text)")).select("doc_id", "item_id")
    assert {tuple(r) for r in plain.collect()} == {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
