"""Seeded draws that are the same on every engine and partitioning: md5 of 'seed|part|part'."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, *parts) -> Column:
    """Hex digest used as a random sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def draw_int(seed: int, *parts) -> Column:
    """Non-negative bigint from the first eight hex digits of the digest."""
    return F.conv(F.substring(draw_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def draw_unit(seed: int, *parts) -> Column:
    """Uniform double in [0, 1)."""
    return draw_int(seed, *parts) / F.lit(4294967296.0)


def draw_bucket(key: Column, hex_digits: int = 3) -> Column:
    """Leading digits of a sort key: an order-preserving split of one group into 16**n parts."""
    return F.substring(key, 1, hex_digits)


# --- the same digests inside tasks, many at a time ----------------------------------------------------

DIGESTS = 1 << 14  # computed at a time: their words stay in the processor's cache
ONE_BLOCK = 55  # bytes of a message that fits one block of MD5
_ADDED = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _one_block(words: list, shape: tuple[int, int], both: bool) -> tuple[np.ndarray, ...]:
    """First word of the MD5 digests of one-block messages, or the first two; each of the 16 words is an array or a number."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64 if both else 61):  # the first word is final three steps before the second
        kind, place = divmod(i, 16)
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        word = words[(place, 5 * place + 1, 3 * place + 5, 7 * place)[kind] % 16]
        f += a
        if isinstance(word, int):
            f += np.uint32((_ADDED[i] + word) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_ADDED[i])
        turn = np.uint32(_TURNS[kind][i % 4])
        np.left_shift(f, turn, out=turned)
        f >>= np.uint32(32) - turn
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    first = (a if both else b) + np.uint32(_START[0])
    return (first, b + np.uint32(_START[1])) if both else (first,)


def leading_digits(heads: Sequence[bytes], tails: Sequence[bytes], both: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of heads, numbers of tails, digits) for all MD5 digests of head + tail, in tables of about DIGESTS cells.

    The digits are the first eight of the hex digest as an unsigned number, or the first sixteen with ``both``.
    """
    lengths = [np.array([len(m) for m in part], int) for part in (heads, tails)]
    for n_tail in np.unique(lengths[1]):
        those = np.flatnonzero(lengths[1] == n_tail)
        text = np.frombuffer(b"".join(tails[i] for i in those), np.uint8).reshape(len(those), n_tail)
        for n_head in np.unique(lengths[0]):
            every = np.flatnonzero(lengths[0] == n_head)
            n = int(n_head + n_tail)
            for start in range(0, len(those), DIGESTS):
                of = those[start : start + DIGESTS]
                at_once = max(1, DIGESTS // len(of))
                if n > ONE_BLOCK:
                    size = 8 if both else 4
                    for h in every:
                        found = b"".join(md5(heads[h] + tails[i]).digest()[:size] for i in of)
                        yield np.array([h]), of, np.frombuffer(found, f">u{size}").astype(f"u{size}").reshape(1, -1)
                    continue
                block = np.zeros((len(of), 64), np.uint8)
                block[:, n_head:n] = text[start : start + DIGESTS]
                block[:, n] = 0x80
                own = np.ascontiguousarray(block.view("<u4").T)
                for begin in range(0, len(every), at_once):
                    some = every[begin : begin + at_once]
                    block = np.zeros((len(some), 64), np.uint8)
                    block[:, :n_head] = np.frombuffer(b"".join(heads[i] for i in some), np.uint8).reshape(len(some), n_head)
                    front = np.ascontiguousarray(block.view("<u4").T)
                    words: list = [0] * 14 + [8 * n, 0]
                    for i in range(n // 4 + 1):
                        words[i] = front[i][:, None] if 4 * i + 4 <= n_head else own[i][None] if 4 * i >= n_head else front[i][:, None] | own[i][None]
                    found = _one_block(words, (len(some), len(of)), both)
                    high = found[0].byteswap()
                    yield some, of, (high.astype(np.uint64) << np.uint64(32)) | found[1].byteswap() if both else high
