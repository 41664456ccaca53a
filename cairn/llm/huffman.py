"""Token ids in files of canonical, length-limited Huffman codes.

A written folder holds two tables: ``code`` (one row: the code length of every
id, from the counts over all documents) and ``blocks`` (one row per block, in
the order part, seq). A block holds the ids of consecutive documents, about
``block_ids`` of them: a bit stream, the bit offset of every ``STEP``-th id
(checkpoints, from which a reader may start), and the ids and lengths of its
documents. Blocks are independent of each other. Parquet is the container, so
a block is written by Spark's commit protocol and a lost task is repeated.

Reading looks up the next ``max_bits`` bits in a table of all codes, for all
checkpoints of a block side by side.

A null text is empty (its end id is still written); documents are ordered by
doc_id, nulls first, ties by a hash of the text; repeated rows are all written;
an empty table gives a folder with no blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import by_size, fresh_path, stored, texts_of

MAX_BITS = 20
STEP = 256
BLOCK_IDS = 1 << 20

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``max_bits``
    (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order].astype(np.int64)
    # Level by level: pairs of the level below, merged with the leaves. A merged
    # list is kept as "how many leaves are among its first k items".
    leaves_before, items = [], w
    for level in range(max_bits):
        if level:
            m = len(items) // 2
            pairs = items[: 2 * m : 2] + items[1 : 2 * m : 2]
            both = np.concatenate((w, pairs))
            by = np.argsort(both, kind="stable")
            is_leaf = by < n
            items = both[by]
        else:
            is_leaf = np.ones(n, dtype=bool)
        leaves_before.append(np.concatenate(([0], np.cumsum(is_leaf))))
    take, ln = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for before in reversed(leaves_before):
        k = int(before[take])
        ln[:k] += 1
        take = 2 * (take - k)
    out[order] = ln
    return out

def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    ln = lengths[ids].astype(np.int64)
    if len(ids):
        top = int(ln.max())
        step = np.uint64(1) << (top - ln).astype(np.uint64)
        first = np.concatenate((np.zeros(1, np.uint64), np.cumsum(step)[:-1]))
        codes[ids] = first >> (top - ln).astype(np.uint64)
    return codes

def decode_table(lengths: np.ndarray, bits: int) -> np.ndarray:
    """Entry for every next ``bits`` bits: id * 32 + code length."""
    table = np.zeros(1 << bits, dtype=np.int64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    ln = lengths[ids].astype(np.int64)
    fill = np.repeat(ids * 32 + ln, 1 << (bits - ln))
    table[: len(fill)] = fill
    return table

def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """(bit stream, big-endian bits, padded by 8 bytes; bit offsets of every STEP-th id; bits)."""
    ln = lengths[ids].astype(np.int64)
    off = np.concatenate((np.zeros(1, np.int64), np.cumsum(ln)))
    total = int(off[-1])
    words = np.zeros(total // 32 + 3, dtype=np.uint64)
    if len(ids):
        at, start = off[:-1] >> 5, (off[:-1] & 31).astype(np.uint64)
        v = codes[ids] << (np.uint64(64) - start - ln.astype(np.uint64))
        head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        words[at[head]] += np.add.reduceat(v >> np.uint64(32), head)
        words[at[head] + 1] += np.add.reduceat(v & np.uint64(0xFFFFFFFF), head)
    return words.astype(">u4").tobytes(), off[:-1:STEP], total

def unpack_bits(stream: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, bits: int) -> np.ndarray:
    """The ``n`` ids of a block; all its checkpoints are followed side by side."""
    w = np.frombuffer(stream, dtype=">u4").astype(np.uint64)
    at = checkpoints.astype(np.int64).copy()
    out = np.zeros((len(at), STEP), dtype=np.uint32)
    mask, last = np.uint64((1 << bits) - 1), n - (len(at) - 1) * STEP
    for k in range(STEP):
        if k == last:
            at = at[:-1]
        if not len(at):
            break
        i = at >> 5
        pair = (w[i] << np.uint64(32)) | w[i + 1]
        e = table[((pair >> (np.uint64(64 - bits) - (at & 31).astype(np.uint64))) & mask).astype(np.int64)]
        out[: len(at), k] = e >> 5
        at += e & 31
    return out.reshape(-1)[:n]

ID_BLOCKS = "part int, seq int, start long, doc_ids array<long>, lengths array<long>, ids binary"
BLOCKS = "part int, seq int, start long, doc_ids array<long>, lengths array<long>, n_ids long, bits binary, checkpoints binary"

def id_blocks(docs: DataFrame, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Ids of whole texts, in doc_id order, in blocks of consecutive documents
    (a longer document has a block of its own); ``start`` counts the ids before
    it in its part."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from cairn.llm.wordids import encoder

        part, enc = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], dtype=np.uint32)
        seq = start = size = 0
        keys, parts = [], []

        def block():
            nonlocal seq, start, size
            row = [[part], [seq], [start], [keys[:]], [[len(p) for p in parts]], [np.concatenate(parts).astype("<u4").tobytes()]]
            seq, start, size = seq + 1, start + size, 0
            keys.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))],
                                              names=["part", "seq", "start", "doc_ids", "lengths", "ids"])

        for whole in batches:
            for b in by_size(whole):
                ids_of = b.column(0).to_pylist()
                for i, ids in enc.encode(b.column(1).to_pylist()):
                    ids = np.concatenate((ids, end))
                    keys.append(ids_of[i])
                    parts.append(ids)
                    size += len(ids)
                    if size >= block_ids:
                        yield block()
        if parts:
            yield block()

    t = texts_of(docs)
    tie = F.xxhash64("text")
    return t.repartitionByRange(F.col("doc_id").asc(), tie.asc()).sortWithinPartitions("doc_id", tie).mapInArrow(run, ID_BLOCKS)

def write_files(docs: DataFrame, path: str, out: str, end_id: int = 0, max_bits: int = MAX_BITS, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text with the tokenizer file ``path``, end each
    document with ``end_id`` and write the ids to the folder ``out``."""
    spark = docs.sparkSession
    blocks = stored(id_blocks(docs, path, end_id, block_ids), "ids")

    def count(batches):
        import pyarrow as pa

        n = np.zeros(0, dtype=np.int64)
        for b in batches:
            for raw in b.column(0):
                c = np.bincount(np.frombuffer(raw.as_buffer(), dtype="<u4"))
                if len(c) > len(n):
                    n, c = c.astype(np.int64), n
                n[: len(c)] += c
        ids = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n[ids])], names=["id", "n"])

    counted = blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, dtype=np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    bits = max(max_bits, int(len(counted)).bit_length())
    lengths = code_lengths(counts, bits)
    parts = blocks.select("part", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row per task
    base, at = {}, 0
    for r in sorted(parts):
        base[r["part"]], at = at, at + r["n"]
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths), base))

    def code(batches):
        import pyarrow as pa

        lengths, codes, base = shared.value
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                ids = np.frombuffer(row.column("ids")[0].as_buffer(), dtype="<u4")
                stream, points, _ = pack_bits(ids, lengths, codes)
                start = row.column("start")[0].as_py() + base[row.column("part")[0].as_py()]
                yield pa.RecordBatch.from_arrays([row.column("part"), row.column("seq"), pa.array([start], pa.int64()), row.column("doc_ids"), row.column("lengths"),
                                                  pa.array([len(ids)], pa.int64()), pa.array([stream], pa.binary()), pa.array([points.astype("<i8").tobytes()], pa.binary())],
                                                 names=["part", "seq", "start", "doc_ids", "lengths", "n_ids", "bits", "checkpoints"])

    blocks.mapInArrow(code, BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")
    spark.createDataFrame([(bits, bytearray(lengths.tobytes()))], "max_bits int, lengths binary").coalesce(1).write.parquet(f"{out}/code")

def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a written folder: doc_id, start (ids of all documents
    before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    head = spark.read.parquet(f"{path}/code").first()
    bits, lengths = head["max_bits"], np.frombuffer(bytes(head["lengths"]), dtype=np.uint8)

    def decode(batches):
        import pyarrow as pa

        table = decode_table(lengths, bits)
        for b in batches:
            for k in range(b.num_rows):
                points = np.frombuffer(b.column("checkpoints")[k].as_buffer(), dtype="<i8")
                n = b.column("n_ids")[k].as_py()
                raw = unpack_bits(b.column("bits")[k].as_buffer(), points, n, table, bits).astype("<u4").tobytes()
                ln = np.array(b.column("lengths")[k].as_py(), dtype=np.int64)
                at = np.concatenate(([0], np.cumsum(ln)))
                keys = b.column("doc_ids")[k].as_py()
                start = b.column("start")[k].as_py() + at[:-1]
                for a in range(0, len(keys), 1000):
                    z = min(a + 1000, len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a:z], pa.int64()), pa.array(start[a:z]), pa.array(ln[a:z]),
                                                      pa.array([raw[4 * x : 4 * y] for x, y in zip(at[a:z].tolist(), at[a + 1 : z + 1].tolist())], pa.binary())],
                                                     names=["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")

def round_trip(docs: DataFrame, path: str, **kw) -> DataFrame:
    """Write to a new folder under the shared scratch folder and read it back."""
    out = fresh_path(docs.sparkSession, "huffman")
    write_files(docs, path, out, **kw)
    return read_files(docs.sparkSession, out)
