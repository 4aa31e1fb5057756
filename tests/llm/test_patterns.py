"""Pattern packing: ids against the tokenizer, places without gaps or overlaps, number of sequences against bounds."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriesloom.llm import patterns

ODD = [
    None, "", " ", "\n\n", "a", "a  b", "a \n b\n\nc", "  x   y", "it's we'll 12,5  \t x　 été", "<|endoftext|> x <|endoftext|>", "x\x1c y\x1f z",
    "tail  ", "\r\nline\r\n\r\nnext", "é é  é", "\U0001f600 \U0001f600", "a" * 5000, "word " * 6000, "a  b \u0085 c", "  lead", "x" * 300 + " y",
]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(patterns.TOKENIZER))


def check(rows, texts, tokenizer, capacity):
    """Every id in exactly one piece with its checksum, pieces cut as stated, sequences gapless."""
    own = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    assert set(own) == set(texts)
    for doc, text in texts.items():
        ids, at = ids_of(tokenizer, text), 0
        pieces = sorted(own[doc], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // capacity)))
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            assert r.length == capacity or r.piece == 0
        assert at == len(ids)
    found = {}
    for r in rows:
        found.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in found.values():
        members.sort()
        assert [m[0] for m in members] == np.cumsum([0, *(m[1] for m in members)]).tolist()[:-1] and sum(m[1] for m in members) <= capacity
    return len(found)


def test_fast_encoder_equals_the_tokenizer(tokenizer):
    path = public_tokenizers.path(patterns.TOKENIZER)
    assert patterns.ranks_of(path) is not None and patterns.ranks_of(public_tokenizers.path("word_bpe_49k.json")) is None
    coder = patterns.ByteCoder(path)
    rng = np.random.default_rng(7)
    latin = [chr(k) for k in range(256)] + list(" \n'etaoinst") * 6
    texts = ["".join(rng.choice(latin, int(rng.integers(1, 60)))) for _ in range(4000)] + [t or "" for t in ODD]
    texts += ["".join(map(chr, rng.choice([32, 10, 39, 101, 233, 0x3A9, 0x4E2D, 0x1F600, 0x2028, 0x3000, 0x660], 20))) for _ in range(500)]
    for text in texts:
        assert coder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("capacity", "block", "rows"), [(2048, 4 << 20, 2000), (64, 40, 3)])
def test_ids_and_places(spark, tokenizer, monkeypatch, capacity, block, rows):
    monkeypatch.setattr(patterns, "TEXT_BYTES", block)
    monkeypatch.setattr(patterns, "EMIT_ROWS", rows)
    texts = dict(enumerate(ODD)) | {100 + k: " ".join(f"w{k % 7}" for k in range(k)) for k in range(40)}
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, length int, part string").repartition(3)
    check(patterns.pack_patterns(df, capacity=capacity).collect(), texts, tokenizer, capacity)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = patterns.op12_pattern_packing(spark, "/root/testdata/sf0.01").collect()
    number = check(rows, {r.doc_id: r.text for r in docs.collect()}, tokenizer, 2048)
    assert number <= 1.005 * (sum(r.length for r in rows) / 2048) + 1


def test_sequences_hold_the_ids(spark, tokenizer):
    df = spark.createDataFrame([(1, "a b c"), (2, "d " * 100), (None, "e"), (2, "d " * 100)], "doc_id long, text string")
    packed = patterns.pack_patterns(df, capacity=64, keep_ids=True)
    held = [np.frombuffer(r.ids, "<u4").tolist() for r in patterns.sequences(packed).collect()]
    assert Counter(x for h in held for x in h) == Counter(x for t in ("a b c", "d " * 100, "e", "d " * 100) for x in ids_of(tokenizer, t))
    assert max(map(len, held)) <= 64
    assert patterns.pack_patterns(df.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", ["lognormal", "uniform", "few", "large", "small", "one"])
def test_plan_holds_every_piece_and_beats_best_fit(lengths):
    rng = np.random.default_rng(1)
    x = {
        "lognormal": np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048), "uniform": rng.integers(1, 2049, 20_000), "few": rng.choice([700, 699, 650, 1000, 333], 20_000),
        "large": rng.integers(900, 2049, 20_000), "small": rng.integers(1, 60, 5000), "one": np.array([7]),
    }[lengths]
    histogram = Counter(x.tolist())
    found = patterns.plan(histogram)
    held = Counter()
    for members, repeats in found:
        assert repeats > 0 and sum(members) <= 2048
        for length in members:
            held[length] += repeats
    assert held == histogram
    # plain best fit decreasing, one piece after the other
    room = np.zeros(2049, int)
    plain = 0
    for n in sorted(x.tolist(), reverse=True):
        at = np.flatnonzero(room[n:])
        if len(at):
            room[n + at[0]] -= 1
            room[at[0]] += 1
        else:
            plain += 1
            room[2048 - n] += 1
    assert sum(repeats for _, repeats in found) <= plain


def test_fit_is_non_negative_and_close():
    lengths, counts = np.array([512, 1024, 1536]), np.array([400, 100, 200])
    rows = patterns.patterns_of(lengths, counts, 2048)
    x = patterns.fitted(rows, counts, 1 - np.where(rows >= 0, lengths[rows], 0).sum(axis=1) / 2048)
    made = np.bincount(np.where(rows >= 0, rows, 3).ravel(), np.repeat(x, 4), 4)[:3]
    assert (x >= 0).all() and np.abs(made - counts).max() < 0.05 * counts.max()
