"""What a task holds at once, and what it gives back."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cairn.llm import common, ngram_join


def test_tasks_give_their_memory_back(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))
    out = common.tidy(lambda batches: (said.append(b) or 2 * b for b in batches))
    assert list(out([1, 2])) == [2, 4] and said == [1, 2, "back"]


def test_a_block_is_sorted_in_bounded_memory():
    block = ngram_join._Block("0-0")
    rng = np.random.default_rng(3)
    for k in range(50):
        block.add(k, np.sort(rng.integers(0, 1 << 63, 10_000, dtype=np.uint64)), k, k)
    n = block.size
    tracemalloc.start()
    rows = ngram_join._emit_ranges(6)(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows.column("n").to_pylist()) == n
    assert peak <= 88 * n and not block.h


def test_shingles_of_other_blocks_are_counted():
    rows = []
    for name, docs in (("a", [[1, 2, 3], [3, 4]]), ("b", [[2, 9], [4, 8]])):
        block = ngram_join._Block(name)
        for k, x in enumerate(docs):
            block.add(k, np.array(x, dtype=np.uint64) << np.uint64(20), k, k)
        rows.append(ngram_join._emit_ranges(0)(block))
    got = ngram_join._meet((0,), pa.Table.from_batches(rows).to_pandas())
    assert {r.block: (np.frombuffer(r.docs, "<i4").tolist(), np.frombuffer(r.n, "<i4").tolist()) for r in got.itertuples()} == {"a": ([0, 1], [1, 1]), "b": ([0, 1], [1, 1])}
