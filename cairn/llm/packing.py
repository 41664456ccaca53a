"""Best-fit packing of token pieces into sequences of a fixed capacity.

``piece_table`` tokenises whole texts and cuts only documents longer than the
capacity. ``pack`` is a bulk-synchronous best fit (decreasing):

1. Pieces get a rank among all pieces of their length (the range sort: order
   by length, then rank). Each task ranks its own rows while writing them; the
   counts of (task, length) are then prefix-summed, so a length that a third
   of all rows share is ranked in parallel.
2. Sweeps from the longest to the shortest length match every run of equal
   pieces to the run of smallest gaps that still hold it (the successor), all
   members of a run at once; a conflict over the members of a gap run is
   settled by rank: the lowest ranks get the gaps, the others look for the next
   successor. The gaps shrink and the sweep repeats until the run is placed;
   new sequences open only when no gap fits. Pieces of one length and
   sequences of one gap are interchangeable, so this state is at most one run
   per length and a bounded number of runs per gap, whatever the number of
   documents.
3. Every row finds its place by its rank, in parallel.

Row order: results name sequence and offset, so any order will do. Documents
with a null text hold the end id only; repeated rows are packed as often as
they occur; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cairn.llm.common import by_size, stored, texts_of, tidy

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_table(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of every whole text: doc_id, piece, start, length, ids_crc32 and,
    for the ranks, the task that made it and its number among that task's
    pieces of the same length."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from cairn.llm.wordids import encoder

        part, enc, seen = TaskContext.get().partitionId(), encoder(path), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype=np.uint32)
        for whole in batches:
            for b in by_size(whole):
                keys, out = b.column(0).to_pylist(), []
                for i, ids in enc.encode(b.column(1).to_pylist()):
                    ids = np.concatenate((ids, end)).astype("<u4", copy=False)
                    raw = ids.tobytes()
                    for k, a in enumerate(range(0, len(ids), capacity)):
                        n = min(capacity, len(ids) - a)
                        out.append((keys[i], k, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), part, int(seen[n])))
                        seen[n] += 1
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return texts_of(docs).mapInArrow(tidy(run), PIECES + ", part int, nth long")


def plan(runs: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, first rank, how many, first sequence, offset) of
    runs (length, count) by best fit decreasing, and the number of sequences.
    Member k of a placement goes to sequence ``first sequence + k``."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    sizes: list[int] = []
    placed, opened = [], 0
    for length, count in sorted(runs, reverse=True):
        rank = 0
        while count:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                per = capacity // length
                new = -(-count // per)
                gaps[capacity] = [(opened, new)]
                bisect.insort(sizes, capacity)
                opened += new
                continue
            gap = sizes[at]
            first, have = gaps[gap].pop()
            take = min(count, have)
            if have > take:
                gaps[gap].append((first + take, have - take))
            elif not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            placed.append((length, rank, take, first, capacity - gap))
            left = gap - length
            if left:
                if left not in gaps:
                    gaps[left] = []
                    bisect.insort(sizes, left)
                gaps[left].append((first, take))
            rank += take
            count -= take
    return placed, opened


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``piece_table``) with sequence_id and offset."""
    pieces = stored(pieces, "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("base", F.sum("n").over(W.Window.partitionBy("length").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)))
    before = stored(before.select("part", "length", "n", F.coalesce("base", F.lit(0)).alias("base")), "ranks")
    runs = [tuple(r) for r in before.groupBy("length").agg(F.sum("n")).collect()]  # at most one row per length
    placed, _ = plan(runs, capacity)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        p = np.array(placed, dtype=np.int64).reshape(-1, 5)
        span = int(p[:, 1].max(initial=0) + p[:, 2].max(initial=0) + 1)
        order = np.argsort(p[:, 0] * span + p[:, 1], kind="stable")
        p = p[order]
        keys = p[:, 0] * span + p[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(keys, length * span + rank, side="right") - 1
            seq = p[k, 3] + rank - p[k, 1] if len(p) else rank
            off = p[k, 4] if len(p) else rank
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(off)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # ``before`` has up to a row per task and length, so it is never broadcast
    ranked = pieces.join(before.drop("n").hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(tidy(place), PIECES + ", sequence_id long, offset long")


def best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset."""
    return pack(piece_table(docs, path, capacity, end_id), capacity)
