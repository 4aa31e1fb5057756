"""Best-fit packing: patterns of few lengths fitted to the histogram of lengths by non-negative least squares.

Only the histogram of lengths reaches the driver, at most as many numbers as a sequence has tokens,
however many documents there are.  What is decided there are patterns and how often each repeats;
the pieces find their sequences by their number within their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.tables import in_batches, lean, saved

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Texts beyond this are encoded in parts.
TEXT_BYTES = 4 << 20
EMIT_ROWS = 2000
#: Lengths that the middle members of a pattern are chosen from.
MIDDLES = 16
STEPS = 200
ROUNDS = 4
#: A round of fewer sequences is the last.
LEAST = 64


def patterns_of(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one to four of ``lengths`` (sorted), a row of four positions each, -1 for none.

    Each is finished by the longest length that still fits.  Middle members come from the
    lengths that hold most tokens and from evenly spread quantiles of them.
    """
    n = len(lengths)
    heavy = np.argsort(-(lengths * counts), kind="stable")[: MIDDLES // 2]
    weight = np.cumsum(lengths * counts)
    even = np.searchsorted(weight, weight[-1] * (np.arange(MIDDLES // 2) + 0.5) / (MIDDLES // 2))
    middle = np.unique(np.concatenate([heavy, np.minimum(even, n - 1)]))
    every, none = np.arange(n), np.full(n, -1)

    def finished(*members: np.ndarray) -> np.ndarray:
        left = capacity - sum(lengths[m] for m in members)
        last = np.searchsorted(lengths, left, side="right") - 1
        fits = last >= 0
        rows = np.stack([*members, last], axis=1)[fits]
        return np.concatenate([rows, np.full((len(rows), 4 - rows.shape[1]), -1)], axis=1)

    a2, b2 = (x.ravel() for x in np.meshgrid(every, middle, indexing="ij"))
    b3, c3 = (x.ravel() for x in np.meshgrid(middle, middle, indexing="ij"))
    some = b3 <= c3
    a4 = np.repeat(every, int(some.sum()))
    b4, c4 = np.tile(b3[some], n), np.tile(c3[some], n)
    found = [np.stack([every, none, none, none], axis=1), finished(every), finished(a2, b2), finished(a4, b4, c4)]
    rows = -np.sort(-np.concatenate(found), axis=1)
    return np.unique(rows, axis=0)


def fitted(patterns: np.ndarray, counts: np.ndarray, waste: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of ``patterns`` whose lengths add up to ``counts`` in least squares.

    Accelerated projected gradient steps; each length is weighted by the root of its count, and
    ``waste`` (the part of a sequence that a pattern leaves empty) is charged a little, so of
    fits that are equally good the fuller one wins.
    """
    n, weight = len(counts), 1 / np.sqrt(counts)
    member, at = patterns >= 0, np.where(patterns >= 0, patterns, 0)
    value = np.where(member, weight[at], 0.0)

    def times(x):
        return np.bincount(at.ravel(), (value * x[:, None]).ravel(), n)

    def back(r):
        return (value * r[at]).sum(axis=1)

    goal = counts * weight
    probe = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = back(times(probe))
        size = np.linalg.norm(probe)
        probe /= size
    x = y = np.zeros(len(patterns))
    t = 1.0
    charge = 0.02 * waste * np.sqrt(counts.max())
    for _ in range(steps):
        new = np.maximum(0, y - (back(times(y) - goal) + charge) / (1.05 * size))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, open_bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a sequence, repeats); equal sequences move together, so work follows the lengths.

    ``open_bins`` are sequences that exist and may take more.
    """
    space: dict[int, list[list]] = {}
    for members, repeats in open_bins:
        space.setdefault(capacity - sum(members), []).append([members, repeats])
    for length, left in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        while left:
            room = min((s for s in space if s >= length), default=None)
            if room is None:
                each = min(capacity // length, left)
                space.setdefault(capacity - each * length, []).append([(length,) * each, left // each])
                left -= each * (left // each)
                continue
            members, repeats = space[room].pop()
            if not space[room]:
                del space[room]
            # as many copies as fit in each of these sequences, then what is left in one more
            each = max(1, min(room // length, left // repeats))
            used = min(repeats, left // each)
            space.setdefault(room - each * length, []).append([members + (length,) * each, used])
            if used < repeats:
                space.setdefault(room, []).append([members, repeats - used])
            left -= each * used
    return [(tuple(members), repeats) for held in space.values() for members, repeats in held]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for ``histogram`` (length: number of pieces) as (lengths, repeats), every piece in one.

    Rounds of: enumerate patterns of the lengths that are left, fit repeats, round down to what
    the histogram still holds, fullest patterns first.  The residual goes by best fit, into the
    gaps of the patterns where it can, after the round that leads to the fewest sequences.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v}
    out = [((capacity,), left.pop(capacity))] if capacity in left else []
    best: tuple[int, list] | None = None
    for round_ in range(ROUNDS + 1):
        rest = np.array(sorted(left.items()), np.int64).reshape(-1, 2)
        closed, gaps = [p for p in out if sum(p[0]) == capacity], [p for p in out if sum(p[0]) < capacity]
        whole = closed + best_fit(rest[:, 0], rest[:, 1], capacity, gaps)
        number = sum(repeats for _, repeats in whole)
        if best is None or number <= best[0]:
            best = number, whole
        more = round_of(rest[:, 0], rest[:, 1], capacity) if round_ < ROUNDS and left else []
        for members, repeats in more:
            for length in members:
                left[length] -= repeats
        left = {k: v for k, v in left.items() if v}
        out += more
        if sum(repeats for _, repeats in more) < LEAST:
            break
    return best[1]


def round_of(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, repeats) of one fit, rounded down to what ``counts`` hold."""
    counts, out = counts.copy(), []
    rows = patterns_of(lengths, counts, capacity)
    used = np.where(rows >= 0, lengths[rows], 0).sum(axis=1)
    full = used >= capacity - capacity // 256
    rows, used = rows[full], used[full]
    x = fitted(rows, counts, 1 - used / capacity) if len(rows) else np.zeros(0)
    for k in np.lexsort((-x, -used)):
        if x[k] >= 1:
            kinds, each = np.unique(rows[k][rows[k] >= 0], return_counts=True)
            times = min(int(x[k]), int((counts[kinds] // each).min()))
            if times:
                counts[kinds] -= each * times
                out.append((tuple(sorted(lengths[rows[k][rows[k] >= 0]].tolist(), reverse=True)), times))
    return out


def ranks_of(path: str):
    """An equal encoder of the same vocabulary that is several times faster, or None where the file does not allow one.

    It needs plain byte-level BPE: no normalizer, the usual word pattern, no prefix blank, and ids in the order of merges.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, words = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and spec.get("normalizer") is None and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    if not plain or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True):
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    return tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Fixed: how byte-level BPE cuts words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteCoder:
    """Ids of whole texts by a tokenizer file.

    Texts of Latin-1 characters without special tokens go through ``ranks_of``, where the file allows it: there the
    two libraries cannot differ in what they take for letters, numbers and white space.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), ranks_of(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                text.encode("latin-1")
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
            except UnicodeEncodeError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def text_parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one long text that the tokenizer would never merge across; without such a place it stays whole.

    Its words begin with at most one blank, and a gap gives its last character to what follows, so a text may be cut
    before that character wherever its neighbours are ASCII.
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    sure = ~blank & (data < 128) & ~((data >= 28) & (data <= 31))  # certainly not white space to the tokenizer
    starts = np.flatnonzero(blank[1:-1] & sure[2:] & (blank[:-2] | sure[:-2])) + 1
    lo = 0
    while len(data) - lo > TEXT_BYTES:
        k = int(np.searchsorted(starts, lo + TEXT_BYTES))
        if k == len(starts):
            break
        yield data[lo : starts[k]]
        lo = int(starts[k])
    yield data[lo:]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long, ids binary"


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """``PIECES`` rows: whole documents, and longer ones cut so that only the first piece is shorter than ``capacity``.

    ``part`` is the task and ``place`` the number of the piece among those of its length in the
    task.  ``ids`` are little-endian unsigned 32-bit numbers, null unless ``keep_ids``.
    """

    def task(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        coder = ByteCoder(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)

        def cut(key, ids: np.ndarray) -> Iterator[tuple]:
            first = (len(ids) - 1) % capacity + 1
            for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                start = max(0, stop - capacity) if piece else 0
                raw = ids[start:stop].tobytes()
                n = stop - start
                yield key, piece, start, n, zlib.crc32(raw), part, int(seen[n]), raw if keep_ids else None
                seen[n] += 1

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"]
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for key, text in zip(keys, batch.column(1), strict=True):
                text = text.as_py() or ""
                if len(text) > TEXT_BYTES:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    parts = [coder.encode(p.tobytes().decode()) for p in text_parts(raw)]
                else:
                    parts = [coder.encode(text)]
                rows += cut(key, np.concatenate([*parts, end]))
                if len(rows) >= EMIT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(chosen).mapInArrow(lean(task), PIECES)


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``token_pieces``, written before) with sequence_id long and offset long.

    Pieces of one length are numbered across tasks from the counts of (task, length), a small
    table.  Each length has a list of stretches of these numbers with the first sequence and the
    offset there; the list is broadcast, and its size depends on ``capacity`` alone.
    """
    spark = pieces.sparkSession
    counts = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    stretches: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for members, repeats in plan(histogram, capacity):
        offset = 0
        for length in members:
            stretches.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + repeats
            offset += length
        sequence += repeats
    table = spark.createDataFrame([(k, v) for k, v in stretches.items()], "length long, stretches array<struct<first:long,sequence:long,offset:long>>")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = pieces.join(counts.select("part", "length", before.alias("before")).hint("merge"), ["part", "length"]).withColumn("number", F.col("before") + F.col("place"))
    where = F.element_at(F.filter("stretches", lambda s: s["first"] <= F.col("number")), -1)
    found = numbered.join(F.broadcast(table), "length").withColumn("_at", where)
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_at.sequence") + F.col("number") - F.col("_at.first")).alias("sequence_id"),
        F.col("_at.offset").alias("offset"), *(["ids"] if "ids" in pieces.columns else []),
    )


def pack_patterns(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Tokenise whole texts and pack them whole: one row per piece with its sequence and its place there.

    A document is its ids and then ``end_id``.  Only documents of more than ``capacity`` ids are
    cut, into pieces of ``capacity``, the first of which may be shorter.

    ``tokenizer`` is a file name known to ``public_tokenizers`` or a path that executors can open.
    Null and empty texts: one piece that is ``end_id``.  A null id stays null.  Repeated rows: each
    is a document of its own.  Empty table: no rows.  Other columns are not read, so their names
    cannot clash.  A very long text is tokenised in parts (same ids).  With ``keep_ids`` the ids
    of a piece are a column, for ``sequences``.
    """
    pieces = token_pieces(docs, id_col, text_col, tokenizer, end_id, capacity, keep_ids)
    return placed(saved(pieces if keep_ids else pieces.drop("ids"), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id long, ids binary): the sequences that ``pack_patterns`` with ``keep_ids`` planned; one holds ``capacity`` ids at most."""
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(members.alias("m")).select("sequence_id", F.aggregate("m", F.lit(b""), lambda a, m: F.concat(a, m["ids"])).alias("ids"))


def op12_pattern_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with the checksum of its ids, packed whole."""
    return pack_patterns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
