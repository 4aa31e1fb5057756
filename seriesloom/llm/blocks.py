"""Text columns as byte blocks: what the vectorised operators of this folder share.

A task sees its rows as Arrow batches.  ``byte_blocks`` hands out stretches of rows whose texts
together hold a bounded number of bytes, ``pieces_of`` cuts one longer text at white space, and
``Words`` finds and hashes all words of a block with a fixed number of array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def byte_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) for stretches of rows of at most ``limit`` bytes, or of one longer row."""
    offsets, data = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def pieces_of(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Cut one text before a space, tab or line end once it passes ``limit`` bytes; a run without any stays whole."""
    blank = np.flatnonzero((data == 32) | (data == 10) | (data == 9)) if len(data) > limit else None
    lo = 0
    while len(data) - lo > limit:
        k = int(np.searchsorted(blank, lo + limit))
        if k == len(blank):
            break
        yield data[lo : blank[k]]
        lo = int(blank[k])
    yield data[lo:]


def text_pieces(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``byte_blocks``, with every longer text cut by ``pieces_of``: the same row then comes several times."""
    for row, offsets, data in byte_blocks(column, limit):
        if len(offsets) == 2 and len(data) > limit:
            for part in pieces_of(data, limit):
                yield row, np.array([0, len(part)]), part
        else:
            yield row, offsets, data


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (one-to-one)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of the multiplier and of its inverse, grown to the longest block seen by a task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, STEP)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, STEP_BACK)]), dtype=np.uint64)
        return self.up[:n], self.down[: n + 1]


class Words:
    """Words of a block: ``start``, ``end`` (bytes), ``row`` (within the block).

    ``member`` says of every byte of the block whether it belongs to a word.  Words never cross rows.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, member: np.ndarray) -> None:
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = member
        opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        if len(edges):  # two texts that touch
            opens[edges] = inside[edges + 1]
            closes[edges - 1] = inside[edges]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        counts = np.diff(np.searchsorted(self.start, offsets))
        self.row = np.repeat(np.arange(len(offsets) - 1), counts)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # number of the first word of each row

    def hashes(self, powers: Powers, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of every word's bytes, after the byte map ``fold``."""
        data = self.data if fold is None else fold[self.data]
        up, down = powers.get(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start])


def byte_table(ranges: str, high: bool) -> np.ndarray:
    """Membership of bytes: the characters of ``ranges``, and all bytes from 0x80 on where ``high``."""
    table = np.zeros(256, bool)
    table[list(ranges.encode("ascii"))] = True
    table[128:] = high
    return table


#: Byte map that lower-cases A-Z and leaves all else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def by_row(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` per row number, for rows 0 to n-1."""
    return np.bincount(row, values, n)
