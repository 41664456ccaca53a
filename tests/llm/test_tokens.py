"""Packing and Huffman files against the library, a small fixture and sf0.001."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairn.llm import huffman, packing

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = [(3, "b c"), (1, None), (2, ""), (3, "b c"), (None, "null id"), (9, "wort " * 3000), (8, "it's 'sing <|endoftext|> x"), (7, " \n")]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_files_round_trip(spark, docs_of):
    t = Tokenizer.from_file(BYTE)
    got = huffman.round_trip(docs_of([(a, b, 1) for a, b in ODD], "doc_id long, text string, ids int"), BYTE, block_ids=50).collect()
    want, at = [], 0
    for d, x in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted([(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got], key=key) == want


def test_files_of_an_empty_table(docs_of):
    assert huffman.round_trip(docs_of([]), BYTE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_code_is_optimal_within_its_limit_and_decodes(seed):
    rng = np.random.default_rng(seed)
    n = [1, 2, 5, 100, 3000, 300][seed]
    ids = rng.zipf(1.3, 20_000) % n
    counts = np.bincount(ids, minlength=n)
    ln = huffman.code_lengths(counts, 12)
    used = counts > 0
    assert ln.max() <= 12 and np.all((ln > 0) == used)
    assert sum(2.0 ** -int(x) for x in ln[used]) <= 1
    import heapq

    h, cost = [int(c) for c in counts[used]], 0
    heapq.heapify(h)
    while len(h) > 1:
        a = heapq.heappop(h) + heapq.heappop(h)
        cost += a
        heapq.heappush(h, a)
    free = huffman.code_lengths(counts, 20)
    assert n == 1 or int((free.astype(int) * counts).sum()) == cost
    stream, points, bits = huffman.pack_bits(ids, ln, huffman.canonical(ln))
    assert bits == int((ln[ids].astype(int)).sum())
    assert np.array_equal(huffman.unpack_bits(stream, points, len(ids), huffman.decode_table(ln, 12), 12), ids)
    part = huffman.unpack_bits(stream, points[3:], len(ids) - 3 * huffman.STEP, huffman.decode_table(ln, 12), 12)  # from a checkpoint
    assert np.array_equal(part, ids[3 * huffman.STEP:])


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_places_everything_gapless(docs_of):
    t = Tokenizer.from_file(WORD)
    rows = packing.best_fit(docs_of([(a, b, 5) for a, b in ODD], "doc_id long, text string, length int"), WORD, capacity=64).collect()
    check_packing(rows, 64)
    want = []
    for d, x in ODD:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want += [(d, k, a, len(ids[a : a + 64]), crc(ids[a : a + 64])) for k, a in enumerate(range(0, len(ids), 64))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)


def test_packing_of_an_empty_table(docs_of):
    assert packing.best_fit(docs_of([]), WORD).collect() == []


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        g = min(fit) if fit else capacity
        if fit:
            gaps.remove(g)
        gaps.append(g - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_as_many_sequences_as_row_by_row_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 50), rng.randint(1, 8), 17]) for _ in range(400)]
    runs = {n: lengths.count(n) for n in lengths}
    placed, opened = packing.plan(runs.items(), 50)
    seqs = {}
    for length, rank, take, first, offset in placed:
        for k in range(take):
            seqs.setdefault(first + k, []).append((offset, length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 50
    assert sum(map(len, seqs.values())) == 400
    assert len(seqs) == opened == plain_best_fit(lengths, 50)
