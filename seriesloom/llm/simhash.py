"""SimHash near-duplicates: fingerprints, segment-popcount embedding, grid range join, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.blocks import BLOCK_BYTES, LOWER, byte_blocks, pieces_of
from seriesloom.llm.tables import components, in_batches, lean, saved, without

BITS = 3
WORDS = 3
SEED = 42
#: Members of one grid cell that a single task compares; larger cells are cut into blocks of this size.
CELL = 16_384
#: Runs up to this length are compared by shifted arrays, longer ones by a breadth-first search.
SHORT_RUN = 48
PAIRS_OF_BITS = np.uint64(0x5555555555555555)


def fingerprint(pieces: Iterator[bytes], words: int = WORDS) -> int:
    """SimHash of one text given as consecutive pieces that are cut at white space.

    Bit i is 1 where more than half of the shingles' XXH64 values have it.  Repeats count.
    Fewer words than a shingle has: the whole sequence; none: 0.
    """
    from xxhash import xxh64_intdigest

    carried: list[bytes] = []
    counts, n = np.zeros(64, np.int64), 0
    for piece in pieces:
        found = carried + piece.split()
        if len(found) >= words:
            line = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
            first = np.concatenate([[0], ends[: len(found) - words]]).tolist()
            values = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, (ends[words - 1 :] - 1).tolist(), strict=True)]
            for at in range(0, len(values), 8192):
                some = np.array(values[at : at + 8192], np.uint64)
                counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(values)
            found = found[len(found) - words + 1 :]
        carried = found
    if not n:
        return xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id long, text_key long, fp long): the fingerprint of every whole text as a signed number; null text: 0.

    ``text_key`` is a hash of the text: with the id it names a row, and rows that share both are copies.
    """

    def task(batches):
        for batch in batches:
            found = []
            for _, offsets, data in byte_blocks(batch.column(2)):
                raw = LOWER[data].tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    parts = [raw[a:b]] if b - a <= BLOCK_BYTES else (p.tobytes() for p in pieces_of(LOWER[data[a:b]], BLOCK_BYTES))
                    found.append(fingerprint(parts, words))
            values = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["doc_id", "text_key", "fp"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return in_batches(chosen).mapInArrow(lean(task), "doc_id long, text_key long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts (0 to 2) of the 32 two-bit segments of each fingerprint, packed into one number."""
    return fp - ((fp >> np.uint64(1)) & PAIRS_OF_BITS)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: a lower bound of the number of differing bits."""
    one = lambda x: ((x >> np.uint64(1)) & PAIRS_OF_BITS) * np.uint64(2) | ((x | (x >> np.uint64(1))) & PAIRS_OF_BITS)
    return np.bitwise_count(one(a) ^ one(b))  # counts in unary: 0, 01, 11


def close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether fingerprints link: first by the bound on their embeddings, then by their own bits."""
    near = manhattan(embed(a), embed(b)) <= bits
    near[near] = np.bitwise_count((a ^ b)[near]) <= bits
    return near


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given links connect, at most one for each end."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def run_links(fp: np.ndarray, own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one long run, found outwards from one member after the other; no two probes are compared."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:64], front[64:]
            near = manhattan(embed(fp[some])[:, None], embed(fp[left])[None, :]) <= bits
            near &= np.bitwise_count(fp[some][:, None] ^ fp[left][None, :]) <= bits
            near &= own[some][:, None] | own[left][None, :]
            hit = near.any(axis=0)
            a.append(fp[left[hit]])
            b.append(fp[some[near[:, hit].argmax(axis=0)]])
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return np.concatenate([np.zeros(0, np.uint64), *a]), np.concatenate([np.zeros(0, np.uint64), *b])


def cell_links(fp: np.ndarray, own: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs (cells) that begin at ``starts``, as a forest."""
    ends = np.append(starts[1:], len(fp))
    length = ends - starts
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    end_of = np.repeat(ends, length)
    at = np.flatnonzero(np.repeat((length > 1) & (length <= SHORT_RUN), length))
    for shift in range(1, SHORT_RUN):
        at = at[at + shift < end_of[at]]
        if not len(at):
            break
        pair = at[own[at] | own[at + shift]]
        hit = pair[close(fp[pair], fp[pair + shift], bits)]
        a.append(fp[hit])
        b.append(fp[hit + shift])
    for k in np.flatnonzero(length > SHORT_RUN):
        for side, found in zip((a, b), run_links(fp[starts[k] : ends[k]], own[starts[k] : ends[k]], bits), strict=True):
            side.append(found)
    return forest(np.concatenate(a), np.concatenate(b))


def fingerprint_links(fps: DataFrame, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """(a long, b long): links that connect exactly the distinct fingerprints ``fps`` (fp) at ``bits`` (at most 3) or fewer differing bits.

    The embedding has 32 counts.  Two fingerprints at 3 or fewer differing bits have embeddings
    within Manhattan distance 3, so in one half (16 counts) within distance 1.  Each half is a
    grid: a fingerprint lies in its own cell of either half and probes the cells that are one
    higher in one count; of two neighbours one probes the other.  Rows with equal cell are
    compared where they meet, first by the bound, then exactly.  Cells that hold more than
    ``cell`` fingerprints are cut into blocks and compared block against block.  What leaves a
    task is a forest, so a group of n near copies gives fewer than n links from each cell.
    """
    if not 0 <= bits <= 3:
        raise ValueError("halves within distance 1 find up to 3 differing bits")

    def probe(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            packed = embed(fp)
            keys, values, owns = [], [], []
            for half in (0, 1):
                e = (packed >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                base = e | np.uint64(half << 32)
                keys.append(base)
                values.append(fp)
                owns.append(np.ones(len(fp), bool))
                for segment in range(16):
                    rest = ((e >> np.uint64(2 * segment)) & np.uint64(3)) < 2
                    keys.append(base[rest] + np.uint64(1 << (2 * segment)))
                    values.append(fp[rest])
                    owns.append(np.zeros(int(rest.sum()), bool))
            columns = [np.concatenate(keys).view(np.int64), np.concatenate(values).view(np.int64), np.concatenate(owns)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "fp", "own"])

    def compare(batches):
        held = None
        for batch in batches:
            cellv = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
            part = (cellv, batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False))
            held = part if held is None else tuple(np.concatenate(x) for x in zip(held, part, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], (held[0][1:] != held[0][:-1]).any(axis=1)]))
            if len(starts) < 2 or len(held[1]) < 100_000:
                continue
            cut = int(starts[-1])  # the last run may go on
            yield links(held[1][:cut], held[2][:cut], starts[:-1])
            held = tuple(x[cut:] for x in held)
        if held is not None and len(held[1]):
            yield links(held[1], held[2], np.flatnonzero(np.concatenate([[True], (held[0][1:] != held[0][:-1]).any(axis=1)])))

    def links(fp, own, starts):
        a, b = cell_links(fp, own, starts, bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rows = fps.mapInArrow(probe, "cell long, fp long, own boolean")
    counts = rows.where("own").groupBy("cell").agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks"))
    crowded = saved(counts.where("blocks > 1"), "crowded")
    rows = rows.withColumn("block", F.lit(0))
    if crowded.head(1):
        number = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
        every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(k, number) * F.col("blocks") + F.greatest(k, number))
        cut = rows.drop("block").join(crowded, "cell").select("cell", "fp", "own", F.explode(every).alias("block"))
        rows = rows.join(crowded, "cell", "left_anti").unionByName(cut)
    rows = rows.select("cell", "block", "fp", "own").repartition("cell", "block").sortWithinPartitions("cell", "block")
    return rows.mapInArrow(compare, "a long, b long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, words: int = WORDS, cell: int = CELL
) -> DataFrame:
    """(doc_id long, text_key long, fp long, root long, component_id long) for every row: groups of texts with linked fingerprints.

    Texts with equal fingerprints are linked without being compared; only distinct fingerprints
    meet.  ``root`` names the group by a fingerprint, ``component_id`` by its smallest id.

    Null and empty texts have fingerprint 0.  A null id takes part but is never a component's
    name (null where no member has one).  Repeated rows and ids: a row each.  Empty table: no
    rows.  Only the two named columns are read.  Very long texts are read in pieces.
    """
    prints = saved(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "classes")
    linked = components(fingerprint_links(classes.select("fp"), bits, cell))
    named = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "low_id", F.coalesce("component", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("low_id").alias("component_id"))
    return prints.join(named.select("fp", "root").join(low, "root"), "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group of ``simhash_groups``, chosen by ``first_of_each``."""
    return first_of_each(docs, simhash_groups(docs, id_col, text_col, bits, words), id_col, text_col)


def first_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group (doc_id, text_key, root): the smallest id (null last), of equal ids the smallest hash of the text.

    The rows to drop are named by id and hash of the text, so texts stay where they are when the
    dropped rows are few enough to broadcast.  Repeated rows of a kept one are dropped as well.
    Extra columns pass through whatever their names.  Empty table: no rows.
    """
    rows = saved(groups.select("doc_id", "text_key", "root"), "groups")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = rows.groupBy("root").agg(F.min(name).alias("best"))
    judged = rows.join(kept, "root").withColumn("stays", name == F.col("best"))
    flags = judged.groupBy("doc_id", "text_key").agg(F.min("stays").alias("stays"), (F.count("*") > 1).alias("again")).where("again OR NOT stays")
    flags = saved(flags.select("doc_id", "text_key", "stays"), "flagged")
    keys = {"doc_id": F.col(id_col).cast("long"), "text_key": F.xxhash64(F.col(text_col).cast("string"))}
    again = flags.where("stays")
    return without(docs, keys, flags.where("NOT stays"), again if again.head(1) else None)


def op7_simhash_groups(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
