"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.blocks import mixed, text_pieces
from seriesloom.llm.tables import in_batches, lean, saved, unused

ORDER = 4
#: Cells (n-grams of the highest order times languages) of a block of models, of which tasks hold one at a time.
BLOCK_CELLS = 16_000_000
#: Symbols that are judged by one block after the other.
HELD_SYMBOLS = 4_000_000
#: A text counts as having this many more letters of usual cross-entropy when it is judged.
PRIOR_LETTERS = 60
#: Letters of evidence that a score counts at most.
SCORE_LETTERS = 40
SEGMENT = 1 << 19
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Lower-case symbol of every code point below 0x10000; 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint16)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


def symbols(offsets: np.ndarray, data: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a block and the row of each: letters in lower case, 0 for each gap after a letter.

    Letters beyond 0xFFFF share the symbol 0xFFFF.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts = lead[offsets]
    found = letters[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        kinds, which = np.unique(points[far], return_inverse=True)
        found[far] = np.array([0xFFFF if chr(k).isalpha() else 0 for k in kinds], np.uint16)[which]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    keep = found != 0
    keep[1:] |= (found[:-1] != 0) & (row[1:] == row[:-1])
    return found[keep], row[keep]


def grams(found: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each symbol: itself and the three before it in its row (0 before the row), packed in 64 bits."""
    packed = found.astype(np.uint64)
    wide, same = packed.copy(), np.ones(len(found), bool)
    for back in range(1, ORDER):
        same = same[1:] & (row[back:] == row[:-back])
        wide[back:] |= np.where(same, packed[:-back], np.uint64(0)) << np.uint64(16 * back)
    return wide


@dataclass
class HashTable:
    """Rows of float32 by 64-bit key: the keys' hashes sorted, with the first place of each leading-bit bucket."""

    hashes: np.ndarray
    rows: np.ndarray
    first: np.ndarray = field(init=False)
    bits: int = field(init=False)

    def __post_init__(self) -> None:
        order = np.argsort(self.hashes)
        self.hashes, self.rows = self.hashes[order], self.rows[order]
        self.bits = max(1, int(len(self.hashes)).bit_length())
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.searchsorted(self.hashes, edges).astype(np.int32)
        self.hashes = np.append(self.hashes, np.uint64(0xFFFFFFFFFFFFFFFF))

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> HashTable:
        return cls(mixed(keys), rows.astype(np.float32))

    def packed(self) -> tuple:
        return self.hashes, self.rows, self.first, self.bits

    @classmethod
    def unpacked(cls, hashes: np.ndarray, rows: np.ndarray, first: np.ndarray, bits: int) -> HashTable:
        """A table from its own arrays, sorted already."""
        table = object.__new__(cls)
        table.hashes, table.rows, table.first, table.bits = hashes, rows, first, bits
        return table

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the key is there)."""
        h = mixed(keys)
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        behind = np.flatnonzero(self.hashes[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < h[behind]]
        hit = self.hashes[at] == h
        hit &= at < len(self.rows)
        return at, hit


@dataclass
class Block:
    """Models of some languages.  For each order n: log P of the n-grams seen in any of them, and log of the backing-off weight of their contexts."""

    languages: list[str]
    tables: list[HashTable] = field(default_factory=list)  # orders 1 to ORDER
    weights: list[HashTable] = field(default_factory=list)  # contexts of orders 2 to ORDER
    floor: np.ndarray | None = None  # log P of a symbol no language has

    def packed(self) -> tuple:
        """As plain arrays, which any task can read."""
        return self.languages, [t.packed() for t in self.tables], [t.packed() for t in self.weights], self.floor

    @classmethod
    def unpacked(cls, parts: tuple) -> Block:
        languages, tables, weights, floor = parts
        return cls(languages, [HashTable.unpacked(*t) for t in tables], [HashTable.unpacked(*t) for t in weights], floor)

    def log_probs(self, wide: np.ndarray) -> np.ndarray:
        """(n, languages): log P of each symbol given the three before it, by language."""
        out = np.zeros((len(wide), len(self.languages)), np.float32)
        at = np.arange(len(wide))
        for n in range(ORDER, 0, -1):
            key = wide[at] & np.uint64((1 << (16 * n)) - 1)
            place, hit = self.tables[n - 1].find(key)
            out[at[hit]] += self.tables[n - 1].rows[place[hit]]
            at, key = at[~hit], key[~hit]
            if not len(at):
                break
            if n == 1:
                out[at] += self.floor
            else:
                place, hit = self.weights[n - 2].find(key >> np.uint64(16))
                out[at[hit]] += self.weights[n - 2].rows[place[hit]]
        return out


@dataclass
class LanguageModels:
    """All languages by name, their models in blocks of consecutive ones, and what each language accepts.

    A block lies in memory or is a broadcast variable; with several, tasks hold one at a time.
    """

    languages: list[str]
    blocks: list = field(default_factory=list)
    usual: np.ndarray | None = None
    limit: np.ndarray | None = None

    def each(self):
        for block in self.blocks:
            if isinstance(block, Block):
                yield block
                continue
            yield Block.unpacked(block.value)
            if len(self.blocks) > 1:
                del block._value  # read again from the executor's disk when its turn comes

    def log_probs(self, wide: np.ndarray) -> np.ndarray:
        return np.concatenate([b.log_probs(wide) for b in self.each()] or [np.zeros((len(wide), 0), np.float32)], axis=1)


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: int | None = None) -> Block:
    """Models from the counts of all highest-order n-grams, {language: (packed n-grams, counts)}.

    Lower orders count in how many contexts an n-gram continues.  One discount for each order and
    language, n1 / (n1 + 2 n2).  The lowest order backs off to equal shares of ``alphabet`` symbols:
    those of all languages (of these, unless given) and one more.
    """
    models = Block(sorted(counts))
    size = len(models.languages)
    if not size:
        return models
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for name in models.languages:
        keys, n = counts[name]
        order = np.argsort(keys)
        by_order[ORDER - 1].append((keys[order], n[order].astype(np.float64)))
        for low in range(ORDER - 1, 0, -1):
            below = by_order[low][-1][0] & np.uint64((1 << (16 * low)) - 1)
            keys, n = np.unique(below, return_counts=True)
            by_order[low - 1].append((keys, n.astype(np.float64)))
    alphabet = alphabet or len(np.unique(np.concatenate([k for k, _ in by_order[0]]))) + 1
    lower = np.zeros((0, size))
    for n in range(1, ORDER + 1):
        every = np.unique(np.concatenate([k for k, _ in by_order[n - 1]]))
        contexts, of = np.unique(every >> np.uint64(16), return_inverse=True)
        p = np.zeros((len(every), size))
        weight = np.ones((len(contexts), size))
        if n > 1:  # probability of the same symbol one order below
            below = np.searchsorted(lower_keys, every & np.uint64((1 << (16 * (n - 1))) - 1))
            base = lower[below]
        else:
            base = np.full((len(every), size), 1 / alphabet)
        for k, (keys, count) in enumerate(by_order[n - 1]):
            if not len(keys):
                p[:, k] = base[:, k]
                continue
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
            at = np.searchsorted(every, keys)
            total = np.bincount(of[at], count, len(contexts))
            kinds = np.bincount(of[at], minlength=len(contexts))
            seen = total > 0
            weight[seen, k] = discount * kinds[seen] / total[seen]
            p[:, k] = weight[of, k] * base[:, k]
            p[at, k] += (count - np.minimum(count, discount)) / total[of[at]]
        models.tables.append(HashTable.of(every, np.log(p)))
        if n > 1:
            models.weights.append(HashTable.of(contexts, np.log(weight)))
        else:
            models.floor = np.log(weight[0] / alphabet).astype(np.float32)
        lower, lower_keys = p, every
    return models


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram long, n long) over all rows with a language: partial counts in tasks, then one aggregation."""

    def task(batches):
        letters, held = letter_table(), {}

        def flush(name):
            keys, n = merged(held.pop(name))
            lang = pa.array([name], pa.string()).take(pa.array(np.zeros(len(keys), np.int64)))
            return pa.RecordBatch.from_arrays([lang, pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        def merged(parts):
            keys = np.concatenate([p[0] for p in parts])
            kinds, which = np.unique(keys, return_inverse=True)
            return kinds, np.bincount(which, np.concatenate([p[1] for p in parts]), len(kinds)).astype(np.int64)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, offsets, data in text_pieces(batch.column(1), SEGMENT):
                found, at = symbols(offsets, data, letters)
                wide = grams(found, at)
                here = np.array([hash(x) for x in names[row : row + len(offsets) - 1]])[at]
                for name in set(names[row : row + len(offsets) - 1]):
                    held.setdefault(name, []).append(np.unique(wide[here == hash(name)], return_counts=True))
                    if sum(len(p[0]) for p in held[name]) > 1_000_000:
                        held[name] = [merged(held[name])]
                        if len(held[name][0][0]) > 500_000 or len(held) > 64:
                            yield flush(name)
        for name in list(held):
            yield flush(name)

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(lean(task), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def blocks_of(sizes: list[tuple[str, int]], cells: int) -> list[list[str]]:
    """Consecutive languages (name, number of n-grams) whose n-grams times languages stay within ``cells``; a larger language stands alone."""
    out: list[list[str]] = []
    total = 0
    for name, n in sorted(sizes):
        if out and (total + n) * (len(out[-1]) + 1) <= cells:
            out[-1].append(name)
            total += n
        else:
            out.append([name])
            total = n
    return out


def fit(train: DataFrame, calibrate: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModels:
    """Models of all languages of ``train``, and for each the highest cross-entropy that it accepts.

    All rows and n-grams count.  The counts are a table in the shared folder; the models of a
    block of languages (BLOCK_CELLS n-grams times languages, or one language) are made at a time
    and broadcast, so the driver and a task hold one block, however many languages there are.
    Calibration: of the rows of ``calibrate`` with at least 20 letters, the 0.999 quantile of the
    cross-entropy of a language's own rows and the 0.001 quantile of all others' under its model;
    the limit lies halfway, or a fifth above the first where the two overlap or nothing else is
    there.  A language without a letter has no model.
    """
    counts = saved(count_grams(train, text_col, lang_col), "gram-counts")
    sizes = [(r.lang, r.n) for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    alphabet = counts.select(F.col("gram").bitwiseAND(F.lit((1 << 16) - 1).cast("long")).alias("symbol")).distinct().count() + 1
    models = LanguageModels(sorted(name for name, _ in sizes))
    names = blocks_of(sizes, BLOCK_CELLS)
    for some in names:
        top = counts.where(F.col("lang").isin(some)).toArrow()
        of = top["lang"].to_numpy(zero_copy_only=False)
        keys, n = top["gram"].to_numpy().view(np.uint64), top["n"].to_numpy()
        block = kneser_ney({name: (keys[of == name], n[of == name]) for name in some}, alphabet)
        models.blocks.append(train.sparkSession.sparkContext.broadcast(block.packed()))
    size = len(models.languages)
    if not size:
        return models
    rows = entropies(calibrate.where(F.col(lang_col).isNotNull()), models, [lang_col], text_col).where("n >= 20")
    each = rows.select(F.col(lang_col).cast("string").alias("own"), F.posexplode("entropy").alias("k", "h"))
    names = F.array(*[F.lit(x) for x in models.languages])
    each = each.withColumn("mine", F.element_at(names, F.col("k") + 1) == F.col("own"))
    found = {
        (r.k, r.mine): r
        for r in each.groupBy("k", "mine").agg(F.avg("h").alias("mean"), F.percentile_approx("h", [0.001, 0.999], 10_000).alias("q")).collect()
    }
    everywhere = [r["mean"] for (_, mine), r in found.items() if mine]
    models.usual, models.limit = np.full(size, np.mean(everywhere) if everywhere else 0.0), np.full(size, np.inf)
    for k in range(size):
        if own := found.get((k, True)):
            other = found.get((k, False))
            models.usual[k] = own["mean"]
            models.limit[k] = (own["q"][1] + other["q"][0]) / 2 if other and other["q"][0] > own["q"][1] else 1.2 * own["q"][1]
    return models


def entropies(docs: DataFrame, models: LanguageModels, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns, n long (letters and gaps), entropy array<double>: nats per symbol of whole texts under each model."""
    name_n, name_h = unused("n", docs.select(*carry)), unused("entropy", docs.select(*carry))
    if text_col in carry and docs.schema[text_col].dataType.simpleString() == "string":
        rows, place = docs.select(*carry), carry.index(text_col)
    else:
        rows, place = docs.select(*carry, F.col(text_col).cast("string").alias(unused("whole text", docs.select(*carry)))), len(carry)

    def judged(parts, total):
        first = 0
        for block in models.each() if parts else ():
            last = first + len(block.languages)
            for rows_of, starts, wide in parts:
                total[rows_of, first:last] -= np.add.reduceat(block.log_probs(wide), starts, axis=0, dtype=np.float64)
            first = last

    def task(batches):
        letters = letter_table()
        for batch in batches:
            total, n, parts = np.zeros((batch.num_rows, len(models.languages))), np.zeros(batch.num_rows, np.int64), []
            for row, offsets, data in text_pieces(batch.column(place), SEGMENT):
                found, at = symbols(offsets, data, letters)
                if not len(found):
                    continue
                counts = np.bincount(at, minlength=len(offsets) - 1)
                full = np.flatnonzero(counts)
                parts.append((full + row, np.cumsum(counts)[full] - counts[full], grams(found, at)))
                n[row : row + len(counts)] += counts
                if len(models.blocks) == 1 or sum(len(p[2]) for p in parts) > HELD_SYMBOLS:
                    judged(parts, total)
                    parts = []
            judged(parts, total)
            each = total / np.maximum(n, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * total.shape[1]), pa.array(each.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(n), lists], [*carry, name_n, name_h])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)
    return in_batches(rows).mapInArrow(lean(task), f"{kinds}{', ' if kinds else ''}`{name_n}` bigint, `{name_h}` array<double>")


def identify(docs: DataFrame, models: LanguageModels, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns of every row and lang_pred string, score double, cross_entropy double, accepted boolean.

    The language with the lowest cross-entropy per symbol (ties: the first by name).  ``score``:
    its share among all languages, from at most SCORE_LETTERS symbols of evidence.  ``accepted``:
    the cross-entropy, drawn towards the language's usual one by PRIOR_LETTERS symbols, does not
    exceed the language's limit.

    Null and empty texts and texts without letters: ``und``, score 0, cross-entropy null, not
    accepted.  Models without any language: ``und`` and accepted.  Very long texts are read in
    pieces.  Repeated rows and null ids: a row each.  Empty table: no rows.  Carried columns keep
    their names; an added column whose name is taken gets an underscore.
    """
    found = entropies(docs, models, carry, text_col)
    n, h = F.col(found.columns[-2]), F.col(found.columns[-1])
    names = [unused(x, docs.select(*carry)) for x in ("lang_pred", "score", "cross_entropy", "accepted")]
    if not models.languages:
        values = [F.lit(UNKNOWN), F.lit(0.0), F.lit(None).cast("double"), F.lit(True)]
        return found.select(*carry, *[v.alias(x) for v, x in zip(values, names, strict=True)])
    array = lambda x: F.array(*[F.lit(y) for y in x])
    best = F.array_min(h)
    k = F.array_position(h, best).cast("int")
    share = 1 / F.aggregate(h, F.lit(0.0), lambda s, x: s + F.exp(F.least(n, F.lit(SCORE_LETTERS)) * (best - x)))
    drawn = (n * best + PRIOR_LETTERS * F.element_at(array(models.usual.tolist()), k)) / (n + PRIOR_LETTERS)
    some = n > 0
    values = [
        F.when(some, F.element_at(array(models.languages), k)).otherwise(UNKNOWN), F.when(some, share).otherwise(0.0),
        F.when(some, best), F.when(some, drawn <= F.element_at(array(models.limit.tolist()), k)).otherwise(False),
    ]
    return found.select(*carry, *[v.alias(x) for v, x in zip(values, names, strict=True)])


def keep_accepted(docs: DataFrame, models: LanguageModels, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``identify`` does not accept; columns stay as they are."""
    found = identify(docs, models, docs.columns, text_col)
    return found.where(F.col(found.columns[-1])).select(*docs.columns)


def fold(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit_on_folds(docs: DataFrame) -> LanguageModels:
    """Models from folds 0 and 1, limits from fold 3; fold 2 is held out, rows with a null id too."""
    return fit(docs.where(fold("doc_id").isin(0, 1)), docs.where(fold("doc_id") == 3))


def op1_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit_on_folds(docs), ["doc_id"])
    return found.withColumn("held_out", F.coalesce(fold("doc_id") == 2, F.lit(False)))
