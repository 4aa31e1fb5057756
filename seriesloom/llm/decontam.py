"""Benchmark decontamination by templates: typed placeholders, hash join of windows, slot consistency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.blocks import LOWER, Powers, Words, byte_blocks, byte_table, mixed, pieces_of
from seriesloom.llm.tables import in_batches, lean, saved, without

WINDOW = 5
COVERAGE = 0.8
#: Bytes of text that a task makes windows of at a time: their arrays take some hundred times as much memory.
BLOCK_BYTES = 1 << 18
#: A window says something only with this many words that are not placeholders.
LITERALS = 2
#: Bits of the filter that documents' windows pass before they are joined.  Its size is fixed; at
#: most this many bit numbers come to the driver, however large the benchmark is.
FILTER_BITS = 1 << 22
UNITS = (
    "mm cm dm m km mg g kg t ml cl l inch inches foot feet ft yard yards mile miles ounce ounces oz pound pounds lb lbs gallon gallons "
    "second seconds sec minute minutes min hour hours h day days week weeks month months year years percent degree degrees dollar "
    "dollars cent cents euro euros meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms "
    "liter liters litre litres watt watts volt volts hz khz mhz ghz kb mb gb tb mph kmh"
).split()
NUMBER, NAME, UNIT = 1, 2, 3
#: A word at the beginning of a sentence that is taken as a word, though it may be a name.
DOUBT = 4

_MEMBER = byte_table("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", high=True)
_DIGIT, _CAPITAL, _STOP = byte_table("0123456789", False), byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ", False), byte_table(".!?", False)


class Templates:
    """Canonical windows of the texts of a block.

    Words are runs of letters, digits and bytes from 0x80 on; a point or comma between digits
    belongs to the number.  ``kind``: number (begins with a digit), unit (a known unit after a
    number), name (begins with a capital within a sentence), else 0.  ``raw``: hash of the word
    in lower case.  A window is WINDOW consecutive words of one text, or all of a shorter one.
    A capital at the beginning of a sentence is left in doubt: its windows stand in both forms,
    as a name and as a word, and the check of the slots decides.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, powers: Powers) -> None:
        member = _MEMBER[data]
        inner = np.flatnonzero((data[1:-1] == 46) | (data[1:-1] == 44)) + 1
        member[inner[_DIGIT[data[inner - 1]] & _DIGIT[data[inner + 1]]]] = True
        words = Words(offsets, data, member)
        n = len(words.start)
        self.raw = words.hashes(powers, LOWER)
        first, same_row = data[words.start], np.zeros(n, bool)
        same_row[1:] = words.row[1:] == words.row[:-1]
        stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int32)])
        inside = same_row.copy()
        inside[1:] &= stops[words.start[1:]] == stops[words.end[:-1]]
        second = data[np.minimum(words.start + 1, max(0, len(data) - 1))]
        capital = _CAPITAL[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        kind = np.zeros(n, np.uint8)
        kind[capital & inside] = NAME
        kind[_DIGIT[first]] = NUMBER
        after = np.zeros(n, bool)
        after[1:] = (kind[:-1] == NUMBER) & same_row[1:]
        kind[np.isin(self.raw, unit_hashes(powers)) & after] = UNIT
        self.kind = kind
        # a capital at the beginning of a sentence may be a name or not: windows with one come in both forms
        maybe = capital & ~inside & (kind == 0)
        self.order = np.concatenate([[0], np.cumsum(maybe)])
        count = np.diff(words.first)
        # windows by their first word; rows with fewer words have one shorter window
        self.size = np.minimum(count[words.row], WINDOW) if n else np.zeros(0, np.int64)
        at = np.arange(n)
        at = at[at + self.size <= words.first[words.row + 1]] if n else at
        doubts = self.order[at + self.size[at]] - self.order[at] if n else at
        # forms: none of these is a name; all are; of two, the first or the second is
        forms = [np.arange(len(at)), np.flatnonzero(doubts > 0), np.flatnonzero(doubts == 2), np.flatnonzero(doubts == 2)]
        self.window = np.concatenate(forms)
        self.form = np.repeat(np.arange(4), [len(f) for f in forms])
        self.maybe, self.at = maybe, at[self.window]
        self.row = words.row[self.at] if n else self.at
        self.position = self.at - words.first[self.row] if n else self.at
        size = self.size[self.at] if n else self.at
        total, literal = np.full(len(self.at), 77, np.uint64) * size.astype(np.uint64), np.zeros(len(self.at), np.int64)
        for k in range(WINDOW if n else 0):
            here = np.minimum(self.at + k, n - 1)
            used, named = size > k, self.named(here, self.at, self.form)
            what = np.where(named, np.uint64(NAME), np.where(kind[here] > 0, kind[here].astype(np.uint64), self.raw[here]))
            total = np.where(used, mixed(total * np.uint64(0x100000001B3) + what), total)
            literal += used & (kind[here] == 0) & ~named
        self.hash, self.plain = total, literal >= np.minimum(LITERALS, size)
        self.words = words

    def named(self, word: np.ndarray, first: np.ndarray, form: np.ndarray) -> np.ndarray:
        """Whether a doubtful word is a name in a form of the window that begins at ``first``."""
        which = self.order[word] - self.order[first]  # 0 for the first doubtful word of the window
        return self.maybe[word] & ((form == 1) | ((form == 2) & (which == 0)) | ((form == 3) & (which == 1)))

    def slots(self, k: int) -> tuple[list[int], list[int]]:
        """Kinds and word hashes of window k."""
        a = self.at[k]
        b = a + self.size[a]
        word = np.arange(a, b)
        named = self.named(word, np.full(len(word), a), np.full(len(word), self.form[k]))
        kinds = np.where(named, NAME, np.where(self.maybe[a:b], DOUBT, self.kind[a:b]))
        return kinds.tolist(), self.raw[a:b].view(np.int64).tolist()


def template_blocks(column: pa.Array, powers: Powers):
    """(first row, templates, words before the block, windows that the last block had) over a text column.

    A longer text comes in pieces. Each begins with the last words of the one before: two that only give context, and
    those whose windows reach into the new piece.
    """
    for row, offsets, data in byte_blocks(column, BLOCK_BYTES):
        if len(offsets) > 2 or len(data) <= BLOCK_BYTES:
            yield row, Templates(offsets, data, powers), 0, 0
            continue
        carried, before, had, pieces = data[:0], 0, 0, list(pieces_of(data, BLOCK_BYTES))
        for k, piece in enumerate(pieces):
            block = np.concatenate([carried, piece])
            t = Templates(np.array([0, len(block)]), block, powers)
            n = len(t.words.start)
            if n <= WINDOW and k + 1 < len(pieces):  # too few words to let any go
                carried = block
                continue
            yield row, t, before, had
            kept = min(n, WINDOW + 1)
            carried, before, had = block[t.words.start[n - kept] :] if kept else block[:0], before + n - kept, max(0, kept - WINDOW + 1)


def unit_hashes(powers: Powers) -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return Words(np.array([0, len(data)]), data, _MEMBER[data]).hashes(powers)


def bit_numbers(h: np.ndarray) -> np.ndarray:
    """The two bits of each hash in the filter."""
    low = np.uint64(FILTER_BITS - 1)
    return np.stack([h & low, (h >> np.uint64(32)) & low]).astype(np.int64)


def windows(table: DataFrame, id_col: str, text_col: str, keep: np.ndarray | None) -> DataFrame:
    """(id long, position long, h long, kinds array<int>, raws array<long>, doubt boolean) of a table's telling windows.

    ``keep``: packed bits of a filter; windows that it rules out are left out.
    """

    def task(batches):
        powers, passes = Powers(), None if keep is None else np.unpackbits(keep).astype(bool)
        for batch in batches:
            keys = batch.column(0)
            for row, t, before, had in template_blocks(batch.column(1), powers):
                if passes is None:
                    telling = np.bincount(t.row, t.plain) > 0 if len(t.row) else np.zeros(0, bool)
                    wanted = t.plain | ~telling[t.row] if len(t.row) else np.zeros(0, bool)
                else:
                    bits = bit_numbers(t.hash)
                    wanted = passes[bits[0]] & passes[bits[1]]
                at = np.flatnonzero(wanted)
                at = at[t.window[at] >= had]
                for lo in range(0, len(at), 20_000):
                    some = at[lo : lo + 20_000]
                    slots = [t.slots(k) for k in some.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(t.row[some] + row)), pa.array(t.position[some] + before), pa.array(t.hash[some].view(np.int64)),
                            pa.array([s[0] for s in slots], pa.list_(pa.int32())), pa.array([s[1] for s in slots], pa.list_(pa.int64())),
                            pa.array(t.form[some] > 0),
                        ],
                        ["id", "position", "h", "kinds", "raws", "doubt"],
                    )

    chosen = table.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    return in_batches(chosen).mapInArrow(lean(task), "id long, position long, h long, kinds array<int>, raws array<long>, doubt boolean")


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """(doc_id long, item_id long, matched long, item_windows long, coverage double, exact boolean): documents that hold an item.

    Numbers, names and units become typed placeholders; windows of five words are joined by the
    hash of their template.  Windows that lie on one diagonal (place in the document less place in
    the item) are one occurrence; it counts if its slots are consistent: equal values of the item
    are equal in the document and different ones different, so a re-parameterised question is
    found and a chance mixture of numbers is not.  A document holds an item if its occurrences
    have at least ``coverage`` of the item's windows, in any of their forms; ``exact``: with
    unchanged slots.
    Windows with fewer than two words that are not placeholders are left out on both sides,
    unless an item has no others.

    Null ids: rows are ignored.  Null and empty texts have no windows: never a match.  Texts
    shorter than a window are one window.  Repeated rows and ids count as one document or item.
    Empty tables: no rows.  Other columns are not read.  Very long texts are read in pieces.  The
    filter sent to tasks has a fixed size; the benchmark itself is joined.
    """
    windows_i = saved(windows(items, item_col, item_text_col, None), "item-windows")
    bits = np.zeros(FILTER_BITS, bool)
    low = F.lit(FILTER_BITS - 1).cast("long")
    ones = windows_i.select(F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32).bitwiseAND(low))).alias("bit")).distinct()
    bits[ones.toPandas()["bit"].to_numpy(np.int64)] = True
    found = windows(docs, id_col, text_col, np.packbits(bits))
    i = windows_i.select(
        "h", F.col("id").alias("item_id"), F.col("position").alias("item_position"), F.col("kinds").alias("item_kinds"), F.col("raws").alias("item_raws"),
        F.col("doubt").alias("item_doubt"),
    )
    plain = lambda kinds: F.transform(kinds, lambda k: k % DOUBT)
    pairs = found.join(i, "h").where(plain("kinds") == plain("item_kinds"))
    # a word that stays a word, though it may be a name, is a slot with one value: no name may take its place elsewhere
    each = F.transform(
        F.arrays_zip("kinds", "item_kinds", "raws", "item_raws"),
        lambda z: F.named_struct(F.lit("kind"), F.greatest(z["kinds"], z["item_kinds"]), F.lit("item"), z["item_raws"], F.lit("doc"), z["raws"]),
    )
    slot = F.transform(
        F.filter(each, lambda s: s["kind"] > 0), lambda s: F.named_struct(F.lit("kind"), F.when(s["kind"] == DOUBT, NAME).otherwise(s["kind"]), F.lit("item"), s["item"], F.lit("doc"), s["doc"])
    )
    # judged twice: with words at sentence beginnings as words only, and with all forms together
    views = F.explode(F.when(F.col("doubt") | F.col("item_doubt"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
    pairs = pairs.select(
        F.col("id").alias("doc_id"), "item_id", F.col("item_position").alias("at"), (F.col("position") - F.col("item_position")).alias("diagonal"),
        slot.alias("slots"), (F.col("raws") == F.col("item_raws")).alias("same"), views.alias("view"),
    )
    occurrence = pairs.groupBy("doc_id", "item_id", "diagonal", "view").agg(
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"), F.collect_set("at").alias("places"), F.min("same").alias("same")
    )
    one_to_one = lambda side: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s[side])))) == F.size("slots")
    held = occurrence.where(one_to_one("item") & one_to_one("doc")).select("doc_id", "item_id", "same", F.explode("places").alias("at"))
    counts = held.groupBy("doc_id", "item_id", "at").agg(F.max("same").alias("same")).groupBy("doc_id", "item_id").agg(
        F.count("*").alias("matched"), F.sum(F.col("same").cast("long")).alias("unchanged")
    )
    sizes = i.select("item_id", "item_position").distinct().groupBy("item_id").agg(F.count("*").alias("item_windows"))
    out = counts.join(sizes, "item_id").withColumn("coverage", F.col("matched") / F.col("item_windows"))
    out = out.withColumn("exact", F.col("unchanged") >= coverage * F.col("item_windows"))
    return out.where(F.col("coverage") >= coverage).select("doc_id", "item_id", "matched", "item_windows", "coverage", "exact")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    Judged by the text alone, named by its hash: of rows with one id only those that hold an item
    go, rows with a null id as well.  Null texts stay.
    """
    key = F.xxhash64(F.col(text_col).cast("string"))
    texts = docs.select(key.alias("text_key"), F.col(text_col).alias("text"))
    bad = saved(contaminated(texts, items, "text_key", "text", **options).select(F.col("doc_id").alias("text_key")).distinct(), "contaminated")
    return without(docs, {"text_key": key}, bad)


def op6_benchmark_templates(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the share of the item that it holds."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
