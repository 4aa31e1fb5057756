"""Packing: token windows of one size from documents of any length, by multiway number partitioning.

Every task tokenises its own documents and packs them as they come, so nothing is shuffled and a
task holds one group of windows at a time.
"""

from __future__ import annotations

import heapq
import os
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.blocks import byte_blocks, pieces_of
from seriesloom.llm.tables import in_batches, lean

WINDOW = 2048
GROUP = 8
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Bytes of text that a task tokenises at a time; what it needs besides the known runs grows with them.
TEXT_BYTES = 2 << 20
#: Runs of text whose ids a task keeps.
KNOWN_RUNS = 1_000_000
EMIT_ROWS = 512
SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"
)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: split item numbers into ``ways`` lists of nearly equal sums.

    Each item starts as a partial partition with one filled way.  The two partial partitions with
    the largest imbalance are merged with opposing ends joined, the fullest way of one with the
    emptiest of the other, until one is left.  Ties go to the earlier partition.
    """
    heap = [(-size, k, [(0, [])] * (ways - 1) + [(size, [k])]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda way: way[0])
        low = both[0][0]
        heapq.heappush(heap, (low - both[-1][0], made, both))
        made += 1
    return [way[1] for way in heap[0][2]] if heap else [[] for _ in range(ways)]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Whole items into near-equal windows: as few as hold them, one more whenever a window overflows."""
    if any(size > capacity for size in sizes):
        raise ValueError("an item exceeds the capacity")
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, ways)
        if all(sum(sizes[k] for k in way) <= capacity for way in found):
            return [way for way in found if way]
        ways += 1


class Packer:
    """Collects pieces (document, start, ids) and yields finished sequences of pieces."""

    def __init__(self, capacity: int, ways: int) -> None:
        self.capacity, self.ways, self.held, self.tokens = capacity, ways, [], 0

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        """``ids`` of one document: whole windows at once, the rest joins the group."""
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield [(doc, len(ids), at, ids[at : at + self.capacity])]
        if whole < len(ids):
            self.held.append((doc, len(ids), whole, ids[whole:]))
            self.tokens += len(ids) - whole
            if self.tokens >= self.ways * self.capacity:
                yield from self.group(self.ways)

    def group(self, ways: int) -> Iterator[list]:
        """Make ``ways`` full windows; what passes their capacity is cut off and stays held."""
        extra = self.tokens - ways * self.capacity
        rest = []
        while extra:
            doc, n, at, ids = self.held.pop()
            keep = max(0, len(ids) - extra)
            rest.append((doc, n, at + keep, ids[keep:]))
            extra -= len(ids) - keep
            if keep:
                self.held.append((doc, n, at, ids[:keep]))
        filled = [[self.held[k] for k in way] for way in differencing([len(x[3]) for x in self.held], ways)]
        self.held, self.tokens = rest[::-1], sum(len(x[3]) for x in rest)
        # near-equal windows: move what is above the capacity of some into the gaps of the others
        over, sums = [], [sum(len(x[3]) for x in way) for way in filled]
        for k, way in enumerate(filled):
            while sums[k] > self.capacity:
                doc, n, at, ids = way.pop()
                keep = max(0, len(ids) - (sums[k] - self.capacity))
                if keep:
                    way.append((doc, n, at, ids[:keep]))
                over.append((doc, n, at + keep, ids[keep:]))
                sums[k] -= len(ids) - keep
        for k, way in enumerate(filled):
            while sums[k] < self.capacity:
                doc, n, at, ids = over.pop()
                take = min(len(ids), self.capacity - sums[k])
                way.append((doc, n, at, ids[:take]))
                if take < len(ids):
                    over.append((doc, n, at + take, ids[take:]))
                sums[k] += take
        yield from filled

    def finish(self) -> Iterator[list]:
        """The end of a task: full windows first, the remainder as sequences whose lengths are powers of two."""
        if self.tokens >= self.capacity:
            yield from self.group(self.tokens // self.capacity)
        while self.held:
            goal = 1 << (self.tokens.bit_length() - 1)
            self.tokens -= goal
            sequence = []
            while goal:
                doc, n, at, ids = self.held.pop(0)
                take = min(goal, len(ids))
                sequence.append((doc, n, at, ids[:take]))
                if take < len(ids):
                    self.held.insert(0, (doc, n, at + take, ids[take:]))
                goal -= take
            yield sequence


def kept_tokenizer(path: str):
    """The tokenizer of a file, loaded once for all tasks of a Python worker that use it one after the other.

    Every tokenizer that was used leaves some MB behind in its process, which add up over the tasks.  Functions come
    anew with each task, so it is kept in a module of its own; a changed file or another one takes its place.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("_seriesloom_tokenizer", types.ModuleType("_seriesloom_tokenizer")).__dict__
    state = (path, os.stat(path).st_mtime_ns, os.stat(path).st_size)
    if kept.get("state") != state:
        kept["state"], kept["tokenizer"] = state, Tokenizer.from_file(path)
    return kept["tokenizer"]


class Memo:
    """Ids of strings seen before; the strings stay in the parts they came in, so none is copied as they grow."""

    def __init__(self) -> None:
        self.strings: list[pa.Array] = []
        self.sizes, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.sizes)

    def add(self, strings: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.strings.append(strings)
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])

    def places(self, strings: pa.Array, encode) -> np.ndarray:
        """Numbers of ``strings``, which are distinct; ``encode`` gives sizes and ids of new ones.

        The known strings are looked up among the asked ones, so the table of hashes is that of the fewer.
        """
        out = np.full(len(strings), -1, np.int64)
        at = pc.fill_null(pc.index_in(pa.chunked_array(self.strings, strings.type), value_set=strings), -1).to_numpy()
        known = np.flatnonzero(at >= 0)
        out[at[known]] = known
        fresh = out < 0
        if fresh.any():
            new = strings.filter(pa.array(fresh))
            out[fresh] = len(self) + np.arange(len(new))
            self.add(new, *encode(new))
        return out

    def gather(self, which: np.ndarray) -> np.ndarray:
        """Ids of the numbered strings, one after the other."""
        sizes, starts, out = self.sizes[which], np.cumsum(self.sizes) - self.sizes, [np.zeros(0, np.uint32)]
        for lo in range(0, len(which), 250_000):
            n = sizes[lo : lo + 250_000]
            shift = np.repeat(starts[which[lo : lo + 250_000]] - (np.cumsum(n) - n), n)
            out.append(self.ids[shift + np.arange(len(shift))])
        return np.concatenate(out)


class Coder:
    """Ids of texts by a tokenizer that drops white space, ignores case and merges nothing across white space.

    Every distinct run between white space is encoded once for a task, as long as the memory for
    runs lasts, and its ids are put wherever it stands. Points and commas that end a run after a
    plain letter or digit are tokens of their own, so they are encoded apart from it.
    """

    #: A run of this form is encoded as what stands before the points and commas, and these.
    ENDED = r"[0-9a-z\x{DF}-\x{F6}\x{F8}-\x{FF}][.,]+$"

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.runs, self.parts = tokenizer, Memo(), Memo()
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        #: Whether an id ends a word, by id; None where the tokenizer does not tell.
        self.ends = None
        if suffix:
            vocabulary = tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True

    def spell(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of new parts; some at a time, as the tokenizer's own records of a part are large.

        Parts of letters only are one word each, so many go through the tokenizer as one text, and the ids that end
        a word tell them apart.
        """
        plain = np.zeros(len(parts), bool)
        if self.ends is not None:
            plain = pc.match_substring_regex(parts, "^[a-z]+$").to_numpy(zero_copy_only=False)
        groups = [(np.flatnonzero(plain), self.spell_words), (np.flatnonzero(~plain), self.spell_each)]
        found = [(at, *spell(parts.take(pa.array(at)))) for at, spell in groups]
        sizes = np.zeros(len(parts), np.int32)
        for at, n, _ in found:
            sizes[at] = n
        starts, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.uint32)
        for at, n, ids in found:
            out[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return sizes, out

    def spell_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
        for lo in range(0, len(words), 512):
            some = words.slice(lo, 512)
            own = np.array(self.tokenizer.encode_batch_fast([" ".join(some.to_pylist())], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[own])
            if len(last) == len(some) and last[-1] == len(own) - 1:
                sizes.append(np.diff(last, prepend=-1).astype(np.int32))
                ids.append(own)
            else:
                n, own = self.spell_each(some)
                sizes.append(n)
                ids.append(own)
        return np.concatenate(sizes), np.concatenate(ids)

    def spell_each(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
        for lo in range(0, len(parts), 8192):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(parts.slice(lo, 8192).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int32, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(ids)

    def learn(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of new runs. Special tokens are told by their case, so runs with "<" stay as they are."""
        low = pc.if_else(pc.match_substring(runs, "<"), runs, pc.ascii_lower(runs))
        ended = pc.match_substring_regex(low, self.ENDED)
        stem = pc.if_else(ended, pc.ascii_rtrim(low, ".,"), low)
        tail = pc.if_else(ended, pc.replace_substring_regex(low, r"^.*[^.,]", ""), "")
        both = pa.concat_arrays([stem, tail.cast(pa.large_string())]).dictionary_encode()
        which = self.parts.places(both.dictionary, self.spell)[both.indices.to_numpy()].reshape(2, -1)
        return self.parts.sizes[which].sum(axis=0, dtype=np.int32), self.parts.gather(which.T.ravel())

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block, and how many each has."""
        # the texts are cut from one valid UTF-8 buffer at their own ends
        texts = pa.LargeStringArray.from_buffers(
            len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
        )
        split = pc.ascii_split_whitespace(texts)
        per_text = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        if len(self.runs) + len(coded.dictionary) > KNOWN_RUNS:
            self.runs, self.parts = Memo(), Memo()
        which = self.runs.places(coded.dictionary, self.learn)[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.runs.sizes[which], dtype=np.int64)])
        return self.runs.gather(which), np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID,
    capacity: int = WINDOW, ways: int = GROUP,
) -> DataFrame:
    """Tokenise whole texts and pack them: one row per piece, with its ids as little-endian unsigned 32-bit numbers.

    A document is its ids and then ``end_id``.  Whole windows of long documents stand alone.
    Remainders gather into groups that fill ``ways`` windows exactly; Karmarkar-Karp differencing
    spreads them over near-equal windows, and the few ids above a window's capacity move into
    the gaps of the others.  A task's last group has as many windows as it fills, and what is left
    becomes sequences with lengths that are powers of two, which need no padding.

    ``tokenizer`` is a file name known to ``public_tokenizers`` or a path that executors can open.
    Null and empty texts: one piece that is ``end_id``.  A null id stays null.  Repeated rows: each
    is a document of its own.  Empty table: no rows.  Other columns are not read, so their names
    cannot clash.  A very long text is cut at white space before it is tokenised (same ids).
    """

    def task(batches):
        import public_tokenizers

        coder = Coder(kept_tokenizer(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)))
        packer, base, number, rows = Packer(capacity, ways), TaskContext.get().partitionId() << 40, 0, []

        def note(sequence):
            nonlocal number
            at, total = 0, sum(len(x[3]) for x in sequence)
            for doc, n, start, ids in sequence:
                rows.append((doc, start, len(ids), n, base + number, at, total, ids.tobytes()))
                at += len(ids)
            number += 1

        def flush():
            columns = [pa.array(x, pa.binary() if k == 7 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids"])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, offsets, data in byte_blocks(batch.column(1), TEXT_BYTES):
                if len(offsets) == 2 and len(data) > TEXT_BYTES:
                    parts = [coder.encode(np.array([0, len(p)]), p)[0] for p in pieces_of(data, TEXT_BYTES)]
                    ids, counts = np.concatenate(parts), np.array([sum(map(len, parts))])
                else:
                    ids, counts = coder.encode(offsets, data)
                at = 0
                for k, n in enumerate(counts.tolist()):
                    for sequence in packer.add(keys[row + k], np.concatenate([ids[at : at + n], end])):
                        note(sequence)
                        if len(rows) >= EMIT_ROWS:
                            yield flush()
                    at += n
        for sequence in packer.finish():
            note(sequence)
        if rows:
            yield flush()

    return in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(task), SCHEMA)


def op2_pack_documents(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with the checksum of its ids."""
    found = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens"
    )
