"""Toxicity: a factorization machine over hashed terms, so that pairs of terms count as well as single ones."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.blocks import LOWER, Powers, Words, byte_table, mixed, text_pieces
from seriesloom.llm.tables import in_batches, lean, saved, unused

#: Bound of the labelled rows that the model is fitted on (a sample by hash of the id, all classes alike).
FIT_ROWS = 40_000
#: Terms of the model: the size of its weights.
MAX_TERMS = 2_048
TERM_COUNTS = ("clean", "toxic", "clean_dense", "toxic_dense")
#: Rows of toxic texts that must hold a term, and the likelihood ratio from which it is kept.
LEAST_ROWS = 3
LEAST_RATIO = 15.0
#: Byte lengths of word beginnings that are terms besides whole words: inflected forms share them.
PREFIXES = (4, 5, 6, 7, 8)
#: Features of a term: (occurrences, share of all words) from which each holds.
LEVELS = ((1, 0.0), (2, 0.0), (4, 0.0), (2, 0.005), (3, 0.01), (3, 0.02))
DENSE = 3
FACTORS = 8
EPOCHS = 30
RATE = 0.1
DECAY = 1e-4
SEED = 5

_MEMBER = byte_table("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", high=True)


def terms(offsets: np.ndarray, data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of every word and word beginning of a block, A-Z in lower case, and the words of each row."""
    words = Words(offsets, data, _MEMBER[data])
    rows, found = [words.row], [words.hashes(powers, LOWER)]
    whole = words.end
    for n in PREFIXES:
        longer = whole - words.start >= n
        part = Words.__new__(Words)
        part.data, part.start, part.end = words.data, words.start[longer], words.start[longer] + n
        rows.append(words.row[longer])
        found.append(mixed(part.hashes(powers, LOWER) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(found), np.diff(words.first)


class Hits:
    """Occurrences of known terms in the rows of one batch, gathered over the pieces of its texts."""

    def __init__(self, known: np.ndarray) -> None:
        self.order = np.argsort(known)
        self.known = np.append(known[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.gate = np.zeros(1 << 22, bool)
        self.gate[(known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.size = len(known)

    def count(self, column: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term number, occurrences) in order of rows, and words of each row."""
        keys, n = [np.zeros(0, np.int64)], np.zeros(len(column), np.int64)
        for row, offsets, data in text_pieces(column):
            at, found, count = terms(offsets, data, powers)
            n[row : row + len(count)] += count
            near = np.flatnonzero(self.gate[(found & np.uint64((1 << 22) - 1)).astype(np.int64)])
            place = np.searchsorted(self.known, found[near])
            hit = self.known[place] == found[near]
            hit &= place < self.size
            keys.append((at[near[hit]] + row) * max(1, self.size) + self.order[place[hit]])
        pairs, occurrences = np.unique(np.concatenate(keys), return_counts=True)
        return pairs // max(1, self.size), pairs % max(1, self.size), occurrences, n


def features(row: np.ndarray, term: np.ndarray, count: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature number), in order of rows: every level that a term of a row reaches."""
    rows, found = [], []
    for level, (least, share) in enumerate(LEVELS):
        holds = (count >= least) & (count >= share * n[row])
        rows.append(row[holds])
        found.append(term[holds] * len(LEVELS) + level)
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((found, rows))
    return rows[order], found[order]


@dataclass
class Machine:
    """w0 + sum of w + sum over pairs of features of the product of their factors, through the logistic function."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, starts: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and sums of factors of rows whose features begin at ``starts`` (each row has some)."""
        linear = np.add.reduceat(self.weights[found], starts)
        v = self.factors[found]
        sums = np.add.reduceat(v, starts, axis=0)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((v**2).sum(axis=1), starts)), sums

    def scores(self, row: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        """Score of rows 0 to n-1; a row without features gets that of the bias."""
        value = np.full(n, self.bias)
        if len(row):
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            value[row[starts]] = self.raw(starts, found)[0]
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def train(known: np.ndarray, row: np.ndarray, found: np.ndarray, toxic: np.ndarray) -> Machine:
    """Logistic loss by AdaGrad over rows in seeded order; rows without features teach the bias."""
    rng = np.random.default_rng(SEED)
    size, share = len(known) * len(LEVELS), (toxic.sum() + 0.5) / (len(toxic) + 1)
    m = Machine(known, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    g0, gw, gv = 1.0, np.ones(size), np.ones((size, FACTORS))
    ends = np.searchsorted(row, np.arange(len(toxic) + 1))
    for _ in range(EPOCHS if len(toxic) else 0):
        order = rng.permutation(len(toxic))
        for lo in range(0, len(order), 64):
            some = order[lo : lo + 64]
            length = (ends[some + 1] - ends[some]).astype(np.int64)
            full = some[length > 0]
            length = length[length > 0]
            error0 = (1 / (1 + np.exp(-m.bias)) - toxic[some[ends[some + 1] == ends[some]]]).sum()
            if len(full):
                starts = np.cumsum(length) - length
                ix = found[np.repeat(ends[full] - starts, length) + np.arange(length.sum())]
                value, sums = m.raw(starts, ix)
                error = 1 / (1 + np.exp(-np.clip(value, -30, 30))) - toxic[full]
                each = np.repeat(error, length)
                used, at = np.unique(ix, return_inverse=True)
                dw = np.bincount(at, each, len(used)) + DECAY * m.weights[used]
                dv = each[:, None] * (np.repeat(sums, length, axis=0) - m.factors[ix])
                dv = np.stack([np.bincount(at, dv[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * m.factors[used]
                gw[used] += dw**2
                gv[used] += dv**2
                m.weights[used] -= RATE * dw / np.sqrt(gw[used])
                m.factors[used] -= RATE * dv / np.sqrt(gv[used])
                error0 += error.sum()
            g0 += error0**2
            m.bias -= RATE * error0 / np.sqrt(g0)
    return m


def likelihood_ratio(a: Column, b: Column, na: int, nb: int) -> Column:
    """G of "in a of na toxic and b of nb other rows", 0 where the term is not more frequent in toxic rows."""
    at_least = lambda c: F.greatest(c.cast("double"), F.lit(1e-9))
    part = lambda k, n, p: k * F.log(at_least(k) / at_least(F.lit(float(n)) * p))
    p = (a + b) / F.lit(float(max(1, na + nb)))
    g = 2 * (part(a, na, p) + part(F.lit(na) - a, na, 1 - p) + part(b, nb, p) + part(F.lit(nb) - b, nb, 1 - p))
    return F.when(a * nb > b * na, g).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from the labelled rows of ``docs``, at most FIT_ROWS of them; texts stay with the tasks.

    Two passes over the chosen rows: how many toxic and other rows hold each term, of which the
    MAX_TERMS that tell the classes apart best are kept, as features of the model; then the
    features of each row.  The driver receives those, two bytes each, of FIT_ROWS rows.
    A row with several labels is toxic if one says so; null labels and null ids are left out.
    """
    by_id = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key"))
    chosen = by_id.agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    chosen = saved(chosen.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS), "labelled")
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = saved(in_batches(texts).join(F.broadcast(chosen), "key").select("toxic", "text"), "labelled-texts")

    def counted(batches):
        powers = Powers()
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, offsets, data in text_pieces(batch.column(1)):
                at, found, n = terms(offsets, data, powers)
                _, place, count = np.unique(mixed(found ^ mixed(at.astype(np.uint64))), return_index=True, return_counts=True)
                kinds, which = np.unique(found[place], return_inverse=True)
                dense = (count >= LEVELS[DENSE][0]) & (count >= LEVELS[DENSE][1] * n[at[place]])
                bad = toxic[first + at[place]] == 1
                sums = [np.bincount(which, w, len(kinds)).astype(np.int64) for w in (~bad, bad, ~bad & dense, bad & dense)]
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), *map(pa.array, sums)], ["term", *TERM_COUNTS])

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sums = rows.mapInArrow(lean(counted), "term long, " + ", ".join(f"{c} long" for c in TERM_COUNTS))
    sums = sums.groupBy("term").agg(*[F.sum(c).alias(c) for c in TERM_COUNTS]).where(F.col("toxic") >= LEAST_ROWS)
    ratio = F.greatest(*[likelihood_ratio(F.col("toxic" + x), F.col("clean" + x), sizes.get(1, 0), sizes.get(0, 0)) for x in ("", "_dense")])
    best = sums.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(MAX_TERMS)
    known = np.sort(best.select("term").toArrow()["term"].to_numpy().view(np.uint64))

    def third(batches):
        hits, powers = Hits(known), Powers()
        for batch in batches:
            row, term, count, n = hits.count(batch.column(1), powers)
            row, found = features(row, term, count, n)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int16)))], ["toxic", "features"])

    table = rows.mapInArrow(lean(third), "toxic int, features array<short>").toArrow()
    lists = table["features"].combine_chunks()
    found = lists.flatten().to_numpy().astype(np.int64) if len(table) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy())) if len(table) else np.zeros(0, np.int64)
    toxic = table["toxic"].to_numpy().astype(np.float64)
    # the order in which tasks answered must not matter
    check = np.zeros(len(toxic), np.uint64)
    np.add.at(check, row, mixed(found.astype(np.uint64) + np.uint64(1)))
    rank = np.empty(len(toxic), np.int64)
    order = np.lexsort((toxic, check))
    rank[order] = np.arange(len(toxic))
    by_rank = np.lexsort((found, rank[row]))
    return train(known, rank[row][by_rank], found[by_rank], toxic[order])


def score(docs: DataFrame, machine: Machine, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns of every row and score double (0 to 1): higher where label 1 is likelier.

    Whole texts.  Null and empty texts, and texts without a known term, get the score of the bias.
    Very long texts are read in pieces.  Repeated rows and null ids: a row each.  Empty table: no
    rows.  If a carried column is called score, the added one gets an underscore.
    """
    name, text = unused("score", docs.select(*carry)), unused("whole text", docs.select(*carry))

    def task(batches):
        hits, powers = Hits(machine.terms), Powers()
        for batch in batches:
            row, term, count, n = hits.count(batch.column(batch.num_columns - 1), powers)
            values = machine.scores(*features(row, term, count, n), len(n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], [*batch.schema.names[:-1], name])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)
    return in_batches(docs).select(*carry, F.col(text_col).cast("string").alias(text)).mapInArrow(lean(task), f"{kinds}{', ' if kinds else ''}`{name}` double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 0."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    found = score(docs, fit(docs, labels.where(fold("doc_id") != 0)), ["doc_id"])
    return found.select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
