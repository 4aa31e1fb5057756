"""Ranked lexical search without an index: every text is scanned by one automaton of all item terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.blocks import LOWER, byte_blocks, byte_table, pieces_of
from seriesloom.llm.tables import in_batches, lean, saved

TOP = 20
#: Bytes of item texts whose terms one automaton holds; more items are searched in further passes over the texts.
AUTOMATON_BYTES = 8 << 20
#: Bytes of text that are scanned at a time.
SCAN_BYTES = 1 << 20
#: Documents that are scored at a time, and scores that a task keeps before it cuts them to the best.
SCORED, HELD = 128, 1 << 18
#: Bytes of terms: digits, letters and everything beyond ASCII.
TERM = byte_table("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", True)
#: Byte map that lower-cases A-Z and turns all that separates terms into a blank.
PLAIN = np.where(TERM, LOWER, 32).astype(np.uint8)
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_lines(texts: pa.Array) -> Iterator[tuple[int, int, str]]:
    """(row, terms, line) for the texts: terms with blanks around each, as one character per byte; a long text comes in pieces."""
    for row, offsets, data in byte_blocks(texts, SCAN_BYTES):
        flat = PLAIN[data]
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for part in pieces_of(flat[a:b], SCAN_BYTES):
                inside = part != 32
                n = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + bool(len(part) and inside[0])
                yield row + k, n, f" {part.tobytes().decode('latin-1')} "


class Scanner:
    """An automaton of guarded terms: a term is found only where blanks stand on both sides, and gives its number."""

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            self.automaton.add_word(f" {term.encode().decode('latin-1')} ", k)
        self.automaton.make_automaton()
        self.empty = not terms

    def documents(self, texts: pa.Array) -> Iterator[tuple[int, int, Counter]]:
        """(row, terms with repeats, occurrences by item term) of every text with a term."""
        at, n, found = -1, 0, Counter()
        for row, terms, line in plain_lines(texts):
            if row != at:
                if n:
                    yield at, n, found
                at, n, found = row, 0, Counter()
            n += terms
            if terms and not self.empty:
                found.update(map(itemgetter(1), self.automaton.iter(line)))
        if n:
            yield at, n, found


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id long, text_key long, terms array<string>) for each distinct row of ``items``."""
    text = F.col(text_col).cast("string")
    terms = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), F.lit(TERM_PATTERN), 0)
    return items.select(F.col(item_col).cast("long").alias("item_id"), F.xxhash64(text).alias("text_key"), terms.alias("terms")).distinct()


def collected(docs: DataFrame, terms: list[str]) -> tuple[int, int, np.ndarray]:
    """Documents with a term (N), their terms (L), and the documents that hold each of ``terms``."""

    def task(batches):
        scanner, number, total, held = Scanner(terms), 0, 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            for _, n, found in scanner.documents(batch.column(0)):
                number += 1
                total += n
                held[list(found)] += 1
        at = np.flatnonzero(held)
        ids, counts = np.concatenate([[-2, -1], at]), np.concatenate([[number, total], held[at]])
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(counts.astype(np.int64))], ["term", "n"])

    sums = in_batches(docs.select("text")).mapInArrow(lean(task), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(len(terms), np.int64)
    n = {-2: 0, -1: 0}
    for r in sums.collect():  # a row for each term at most
        if r.term < 0:
            n[r.term] = r.n
        else:
            df[r.term] = r.n
    return n[-2], n[-1], df


def weights(number: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) for each term."""
    return np.array([math.floor(1000 * math.log((2 * number + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The best ``top`` documents of each item so far; equal scores by ascending document."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.floor = top, np.ones(items, np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: a row per document, a column per item."""
        row, item = np.nonzero(scores >= self.floor)
        self.rows.append((item, scores[row, item], docs[row]))
        self.size += len(row)
        if self.size > max(HELD, 2 * self.top * len(self.floor)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, doc = (np.concatenate(c) if self.rows else np.zeros(0, np.int64) for c in (zip(*self.rows, strict=True) if self.rows else ((),) * 3))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        start = np.searchsorted(item, item)
        rank = np.arange(len(item)) - start
        last = rank == self.top - 1
        self.floor[item[last]] = score[last]
        keep = rank < self.top
        self.rows, self.size = [(item[keep], score[keep], doc[keep])], int(keep.sum())
        return self.rows[0]


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """(item_id long, text_key long, rank int, doc_id long, score long): the ``top`` documents of each item with a score above 0.

    A term is a maximal run of digits, letters and characters beyond ASCII, A-Z in lower case.
    All texts are scanned twice, and nothing but a row per task and term or item leaves a task:
    the first scan counts documents, terms and how many documents hold each item term, the
    second scores.  In a document of n terms, a term with tf occurrences counts
    w * ((10**9 * tf) div (1000 * tf + 12 * m)), m = 75 + (25 * n * N) div L, once for each time
    that it stands in the item, w = floor(1000 * ln((2N + 2) / (2df + 1))).

    Each distinct row of ``items`` is an item; rows of one id with unlike texts are told by
    ``text_key``, repeated rows are one.  Items without a term: no rows.  Items beyond
    ``automaton_bytes`` of text are dealt into further passes, so what is shipped with a pass
    is bounded by that and the longest item.  Repeated documents: a row each.  A null id comes
    last among equal scores.  Null and empty texts have no terms.  Empty tables: no rows.  Very
    long texts are scanned in pieces.  No other column is read.
    """
    wanted = saved(item_terms(items, item_col, item_text), "items")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = wanted.agg(F.sum(F.length(F.concat_ws(" ", "terms")))).first()[0] or 0
    passes = max(1, -(-2 * size // automaton_bytes))
    found = None
    for k in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "text_key"), F.lit(passes)) == k)
        rows = [(r.item_id, r.text_key, r.terms) for r in part.where(F.size("terms") > 0).collect()]  # bounded by automaton_bytes
        some = best_of(texts, rows, top)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item_id", "text_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "text_key", "rank", "doc_id", "score")


def best_of(texts: DataFrame, items: list[tuple], top: int) -> DataFrame:
    """(item_id, text_key, doc_id, score): the ``top`` of every task for each of ``items`` (id, key, terms)."""
    terms = sorted({t for _, _, own in items for t in own})
    place = {t: k for k, t in enumerate(terms)}
    number, total, df = collected(texts, terms)
    w = weights(number, df)
    names = [(i, key) for i, key, _ in items]
    pairs = [(place[t], k, n) for k, (_, _, own) in enumerate(items) for t, n in Counter(own).items()]
    at, item, n_times = (np.array(c, np.int64) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
    order = np.argsort(at, kind="stable")
    item, n_times = item[order], n_times[order]
    start = np.searchsorted(at[order], np.arange(len(terms) + 1))  # the outputs of term k: items start[k] to start[k+1]

    def scored(docs: list[tuple[int, Counter]]) -> np.ndarray:
        """Scores (document, item): what a term adds goes to all items that the automaton's output maps to."""
        row = np.repeat(np.arange(len(docs)), [len(found) for _, found in docs])
        term = np.array([t for _, found in docs for t in found], np.int64)
        tf = np.array([c for _, found in docs for c in found.values()], np.int64)
        m = np.array([75 + 25 * n * number // total for n, _ in docs], np.int64)
        gain = w[term] * ((10**9 * tf) // (1000 * tf + 12 * m[row]))
        fan = start[term + 1] - start[term]
        out = np.repeat(start[term] - (np.cumsum(fan) - fan), fan) + np.arange(int(fan.sum()))
        cell, value = np.repeat(row, fan) * len(names) + item[out], np.repeat(gain, fan) * n_times[out]
        # sums of parts below 2**53 are exact in doubles: high and low halves are added apart
        low = np.bincount(cell, value & 0xFFFFFF, len(docs) * len(names)).astype(np.int64)
        high = np.bincount(cell, value >> 24, len(docs) * len(names)).astype(np.int64)
        return ((high << 24) + low).reshape(len(docs), len(names))

    def task(batches):
        scanner, best, held, ids = Scanner(terms), Best(len(names), top), [], []
        for batch in batches:
            # null ids sort last
            keys = batch.column(0).to_pylist()
            for row, n, found in scanner.documents(batch.column(1)):
                if found:
                    held.append((n, found))
                    ids.append(NULL_ID if keys[row] is None else keys[row])
                if len(held) == SCORED:
                    best.add(np.array(ids, np.int64), scored(held))
                    held, ids = [], []
        if held:
            best.add(np.array(ids, np.int64), scored(held))
        item, score, doc = best.cut()
        columns = [pa.array([names[k][0] for k in item.tolist()], pa.int64()), pa.array([names[k][1] for k in item.tolist()], pa.int64())]
        columns += [pa.array(doc, mask=doc == NULL_ID), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "text_key", "doc_id", "score"])

    return in_batches(texts).mapInArrow(lean(task), "item_id long, text_key long, doc_id long, score long")


NULL_ID = np.iinfo(np.int64).max


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", "doc_id", "score")


OP11_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '{TERM_PATTERN}') AS terms
  FROM documents),
d AS (SELECT row, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
item AS (
  SELECT DISTINCT item_id, text, regexp_extract_all(translate(text, '{UPPER}', '{SMALL}'), '{TERM_PATTERN}') AS terms FROM benchmark),
asked AS (SELECT item_id, text, term, count(*)::BIGINT AS times FROM (SELECT item_id, text, unnest(terms) AS term FROM item) GROUP BY ALL),
tf AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), total),
gain AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS gain
  FROM tf JOIN w USING (term), total),
score AS (SELECT item_id, text, row, doc_id, sum(gain * times)::BIGINT AS score FROM gain JOIN asked USING (term) GROUP BY ALL HAVING sum(gain * times) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
