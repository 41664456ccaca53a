"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard
similarity of at least a threshold, as components of links.

1. *Sets.* A text (A-Z lowered) gives its distinct shingles of ``WORDS`` words
   as 64-bit hashes; a shorter text gives its whole word sequence. Equal sets
   (128-bit key) are one class, whose smallest doc_id stands for it.
2. *Count filter.* A document with a partner shares ``threshold`` of its
   shingles with some other document. Blocks of documents send each distinct
   shingle once, packed and sorted, to its hash range; ranges tell which occur
   in another block; documents with too few such shingles are done. A shingle
   that a third of all rows hold is one entry per block.
3. *Prefixes under several global orders.* An order ranks shingles by frequency
   class (a hashed count table of fixed size), then by a hash of its own. Of n
   shingles, a pair must share one among the first n - ceil(t n) + 1 of each
   side, under every order. The first order makes the candidates; the other
   orders' prefixes must meet as well before the sets are compared.
4. *Links without all pairs.* Each prefix shingle's documents are compared with
   one leader, twice with another leader; what is linked then is one component.
   Shingles whose documents still lie in several components are compared pair
   by pair across components: small groups as pairs of ids, large groups in
   tasks of two cells of bounded size (by length class and hash), which return
   only links that join components. So no link is lost, and a large group of
   near copies never becomes a table of all its pairs.

Null and empty texts have no shingles and no links. Rows with equal doc_id are
one vertex. Rows without a doc_id link with nothing and get a null component.
An empty table gives no rows; of other columns only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import by_size, discard, give_back, stored, texts_of, tidy
from cairn.llm.group_links import group_links

WORDS = 4
THRESHOLD = 85  # per cent
ORDERS = 3
BLOCK = 1 << 21  # shingles sorted together
RANGE = 1 << 21  # shingles that meet in one task
SMALL = 48  # documents of a prefix shingle compared as pairs of ids
CELL = 192  # documents of one side of a task for larger ones
BROADCAST_ROWS = 500_000
TABLE_BITS = 20
BATCH = 2 << 20


def shingles(texts: list[str], words: int = WORDS):
    """Distinct shingle hashes of each text, sorted: (hashes, first of each text and the end)."""
    from cairn.llm.wordids import mix, span_hashes, to_codes

    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    codes = to_codes("".join(texts))
    n = len(codes)
    empty = np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    if not n:
        return empty
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    cut = np.ones(n + 1, dtype=bool)
    np.not_equal(blank[1:], blank[:-1], out=cut[1:-1])
    cut[at] = True
    s = np.flatnonzero(cut[:-1])
    e = np.append(s[1:], n)
    keep = ~blank[s]
    s, e = s[keep], e[keep]
    if not len(s):
        return empty
    codes = codes + np.where((codes >= 65) & (codes <= 90), 32, 0).astype(np.uint32)
    h = span_hashes(codes, s, e)
    doc = np.searchsorted(at, s, side="right") - 1
    k = np.uint64(0x9E3779B97F4A7C15)
    x = h[: max(0, len(h) - words + 1)].copy()
    for i in range(1, words):
        x = mix(x * k + h[i : i + len(x)])
    ok = doc[: len(x)] == doc[words - 1 :] if len(x) else np.zeros(0, bool)
    hs, ds = [x[ok]], [doc[: len(x)][ok]]
    count = np.bincount(doc, minlength=len(texts))
    first = np.searchsorted(doc, np.arange(len(texts)))
    for d in np.flatnonzero((count > 0) & (count < words)).tolist():
        v = np.array([count[d]], dtype=np.uint64)
        for i in range(count[d]):
            v = mix(v * k + h[first[d] + i])
        hs.append(v)
        ds.append(np.array([d]))
    hs, ds = np.concatenate(hs), np.concatenate(ds)
    order = np.lexsort((hs, ds))
    hs, ds = hs[order], ds[order]
    new = np.ones(len(hs), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    hs, ds = hs[new], ds[new]
    return hs, np.searchsorted(ds, np.arange(len(texts) + 1))


def set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each set."""
    from cairn.llm.wordids import mix

    out = []
    for c in (0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7):
        s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(c)))))
        out.append((s[first[1:]] - s[first[:-1]]).view(np.int64))
    return out[0], out[1]


def need(n, percent: int):
    """ceil(percent n / 100)."""
    return -(-percent * n // 100)


# --- 2. count filter -------------------------------------------------------


class _Block:
    """Documents whose shingles are sorted together; equal sets once."""

    def __init__(self, name: str):
        self.name, self.h, self.d, self.keys, self.rows, self.size = name, [], [], {}, [], 0

    def add(self, doc_id, h, k1, k2):
        key = (k1, k2, len(h))
        if key in self.keys:
            return
        self.keys[key] = len(self.rows)
        self.h.append(h)
        self.d.append(np.full(len(h), len(self.rows), dtype=np.int32))
        self.rows.append((doc_id, len(h), k1, k2))
        self.size += len(h)

    def distinct(self):
        """(distinct shingles, document of each or -1 where several hold it, how many shared shingles each document has)."""
        h, d = np.concatenate(self.h), np.concatenate(self.d)
        self.h, self.d = [h], [d]  # the parts are held no longer
        order = np.argsort(h)
        h, d = h[order], d[order]
        del order
        new = np.ones(len(h) + 1, dtype=bool)
        new[1:-1] = h[1:] != h[:-1]
        several = ~(new[:-1] & new[1:])
        shared = np.bincount(d[several], minlength=len(self.rows))
        d[several] = -1
        return h[new[:-1]], d[new[:-1]], shared


def _blocks(words: int, emit):
    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        block = _Block(f"{part}-0")
        for whole in batches:
            for b in by_size(whole, limit=BATCH):
                h, first = shingles(b.column("text").to_pylist(), words)
                k1, k2 = set_keys(h, first)
                for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                    if first[i + 1] > first[i]:
                        block.add(doc_id, h[first[i] : first[i + 1]], int(k1[i]), int(k2[i]))
                if block.size >= BLOCK:
                    done, block = block, None
                    yield emit(done)
                    seq += 1
                    done, block = None, _Block(f"{part}-{seq}")
        if block.rows:
            yield emit(block)

    return tidy(run)


def _emit_ranges(bits: int):
    def emit(block):
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        h, d, _ = block.distinct()
        block.h, block.d = [], []
        at = np.append(np.searchsorted(h, np.array([k << (64 - bits) for k in range(1 << bits)], dtype=np.uint64)), len(h))
        w = h >> np.uint64(16)  # 48 bits will do to find what occurs twice; sets are compared in full later
        del h
        step = np.zeros(len(w), dtype=np.uint64)
        np.subtract(w[1:], w[:-1], out=step[1:])
        rows = []
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if b > a:
                s = step[a:b].copy()
                s[0] = w[a]
                rows.append((k, block.name, b - a, z.compress(s.view(np.uint8).reshape(-1, 8).T.tobytes() + d[a:b].astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int32(), pa.binary()))], names=["range", "block", "n", "packed"])

    return emit


def _meet(key, pdf):
    """``_in_other_blocks``, whose memory is given back."""
    out = _in_other_blocks(pdf)
    give_back()
    return out


def _in_other_blocks(pdf):
    """Of one hash range: how many shingles of each block's documents occur in another block."""
    import pandas as pd
    import zstandard

    z = zstandard.ZstdDecompressor()
    ends = np.cumsum(pdf["n"].to_numpy(np.int64))
    total = int(ends[-1])
    v, d, b = np.empty(total, np.uint64), np.empty(total, np.int32), np.empty(total, np.int32)
    for k, (n, end, raw) in enumerate(zip(pdf["n"], ends.tolist(), pdf["packed"])):
        raw, own = np.frombuffer(z.decompress(raw), np.uint8), slice(end - n, end)
        np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").reshape(-1), out=v[own])
        d[own] = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<i4").reshape(-1)
        b[own] = k
    order = np.argsort(v, kind="stable")
    v = v[order]
    same = v[1:] == v[:-1]
    del v
    twice = np.zeros(total, dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    del order
    hit = hit[d[hit] >= 0]
    b, d = b[hit], d[hit]
    out = []
    names = pdf["block"].tolist()
    by = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[by], np.arange(len(names) + 1))
    for k, name in enumerate(names):
        docs, n = np.unique(d[by[cuts[k] : cuts[k + 1]]], return_counts=True)
        if len(docs):
            out.append((name, docs.astype("<i4").tobytes(), n.astype("<i4").tobytes()))
    return pd.DataFrame(out, columns=["block", "docs", "n"])


def _emit_heads(block):
    import pyarrow as pa

    shared = block.distinct()[2]
    ids, n, k1, k2 = zip(*block.rows)
    kinds = [pa.list_(pa.int64())] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([block.name])] + [pa.array([list(c)], t) for c, t in zip((ids, n, k1, k2, shared.tolist()), kinds)], names=["block", "doc_ids", "n", "k1", "k2", "shared"])


def _enough(percent: int):
    def run(key, heads, met):
        import pandas as pd

        out = []
        for _, r in heads.iterrows():
            shared = np.array(r["shared"], dtype=np.int64)
            for docs, n in zip(met["docs"], met["n"]):
                shared[np.frombuffer(docs, "<i4")] += np.frombuffer(n, "<i4")
            size = np.array(r["n"], dtype=np.int64)
            for i in np.flatnonzero(shared >= need(size, percent)).tolist():
                out.append((r["doc_ids"][i], size[i], r["k1"][i], r["k2"][i]))
        return pd.DataFrame(out, columns=["doc_id", "n", "k1", "k2"])

    return run


def with_shared_shingles(t: DataFrame, percent: int, words: int) -> DataFrame:
    """(k1, k2, n): the distinct sets of which enough shingles occur in another set. ``t`` (doc_id, text) is read twice and must
    give the same rows in the same order, as a stored table does."""
    chars = t.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, chars / 5 / RANGE))))
    ranges = t.mapInArrow(_blocks(words, _emit_ranges(bits)), "range int, block string, n int, packed binary")
    met = ranges.repartition(1 << bits, "range").groupBy("range").applyInPandas(_meet, "block string, docs binary, n binary")
    heads = t.mapInArrow(_blocks(words, _emit_heads), "block string, doc_ids array<long>, n array<long>, k1 array<long>, k2 array<long>, shared array<long>")
    found = heads.groupBy("block").cogroup(met.groupBy("block")).applyInPandas(_enough(percent), "doc_id long, n long, k1 long, k2 long")
    return found.select("k1", "k2", "n").distinct()


# --- 3. orders and prefixes ------------------------------------------------


def frequency_classes(sets: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """Logarithm class of the count of every hash bucket (``2**bits`` of them,
    whatever the input)."""
    slices = 16

    def count(batches):
        import pyarrow as pa

        n = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            h = np.frombuffer(b"".join(b.column("payload").to_pylist()), "<u8")
            n += np.bincount((h & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        if n.any():
            for k, part in enumerate(np.split(n, slices)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["slice", "n"])

    def add(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(x, "<i8") for x in pdf["n"])
        return pd.DataFrame({"slice": [int(key[0])], "n": [np.ceil(np.log2(total + 1)).astype(np.uint8).tobytes()]})

    got = sets.select("payload").mapInArrow(tidy(count), "slice int, n binary").groupBy("slice").applyInPandas(add, "slice int, n binary").collect()  # 2**bits bytes in all
    out = np.zeros((slices, (1 << bits) // slices), dtype=np.uint8)
    for r in got:
        out[r["slice"]] = np.frombuffer(bytes(r["n"]), np.uint8)
    return out.reshape(-1)


def prefix(h: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The shingles of a set that come first under an order."""
    from cairn.llm.wordids import mix

    p = len(h) - need(len(h), percent) + 1
    c = classes[(h & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64)
    rank = (c << np.uint64(56)) | (mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (order + 1) & (1 << 64) - 1)) >> np.uint64(8))
    return h[np.argpartition(rank, p - 1)[:p]] if p < len(h) else h


# --- 4. links --------------------------------------------------------------


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted arrays without repeats share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int(np.count_nonzero(y[at] == x))


class JaccardOfSets:
    """Sets (sorted 64-bit shingles) for ``group_links``."""

    def __init__(self, classes: np.ndarray, percent: int):
        self.classes, self.percent = classes, percent

    def load(self, raw: bytes):
        """The set and its prefix under every order but the first."""
        h = np.frombuffer(raw, "<u8")
        return h, [np.sort(prefix(h, self.classes, k, self.percent)) for k in range(1, ORDERS)]

    def tokens(self, item) -> list[int]:
        """The prefix under the first order, by which candidates are found."""
        return prefix(item[0], self.classes, 0, self.percent).tolist()

    def linked(self, a, b) -> bool:
        """Do the prefixes meet under the other orders as well, and are the sets similar enough?"""
        (x, px), (y, py) = a, b
        if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
            return False
        if not all(in_common(p, q) for p, q in zip(px, py)):
            return False
        both = in_common(x, y)
        return 100 * both >= self.percent * (len(x) + len(y) - both)


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the sets (id, n, payload) that are linked with another."""
    similarity = JaccardOfSets(frequency_classes(sets), percent)
    shared = sets.sparkSession.sparkContext.broadcast(similarity)

    def post(batches):
        import pyarrow as pa

        classes = shared.value.classes
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = b.column("id").to_pylist(), b.column("n").to_pylist()
            p = [prefix(np.frombuffer(x.as_buffer(), "<u8"), classes, 0, percent) for x in b.column("payload")]
            ln = [len(x) for x in p]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).view(np.int64)), pa.array(np.repeat(ids, ln), pa.int64()), pa.array(np.repeat(n, ln), pa.int64())], names=["token", "id", "n"])

    return group_links(sets.mapInArrow(tidy(post), "token long, id long, n long"), sets, shared, percent, SMALL, CELL)


def sets_of(t: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(id, n, payload): the sets of the documents in ``reps`` (rep, n, k1, k2), read again from their texts."""
    ids = reps.select(F.col("rep").alias("doc_id"), "k1", "k2", "n")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in by_size(whole, limit=BATCH):
                h, first = shingles(b.column("text").to_pylist(), words)
                k1, k2 = set_keys(h, first)
                ok = [i for i, (x, y, n) in enumerate(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("n").to_pylist())) if (k1[i], k2[i], first[i + 1] - first[i]) == (x, y, n)]
                ids = b.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in ok], pa.int64()), pa.array([int(first[i + 1] - first[i]) for i in ok], pa.int64()),
                                                  pa.array([h[first[i] : first[i + 1]].astype("<u8").tobytes() for i in ok], pa.binary())], names=["id", "n", "payload"])

    return stored(t.join(ids, "doc_id").select("doc_id", "text", "k1", "k2", "n").mapInArrow(tidy(run), "id long, n long, payload binary").dropDuplicates(["id", "n", "payload"]), "sets", "none")


def sizes_and_keys(t: DataFrame, words: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in by_size(whole, limit=BATCH):
                h, first = shingles(b.column("text").to_pylist(), words)
                k1, k2 = set_keys(h, first)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), pa.array(k1), pa.array(k2)], names=["doc_id", "n", "k1", "k2"])

    return t.mapInArrow(tidy(run), "doc_id long, n long, k1 long, k2 long")


def join(docs: DataFrame, percent: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the size of its
    set and the smallest doc_id reachable by links, itself included. ``docs``
    must give the same rows in the same order when read again."""
    t = texts_of(docs)
    keys = stored(sizes_and_keys(t, words), "keys")
    known = t.where(F.col("doc_id").isNotNull())
    # classes of equal sets; the smallest doc_id stands for each
    classes = stored(keys.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    reps = stored(with_shared_shingles(known, percent, words).join(classes, ["k1", "k2", "n"]).select("rep", "k1", "k2", "n"), "reps")
    sets = sets_of(known, reps, words)
    label = links(sets, percent)
    discard(sets, reps)
    reach = classes.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").where("component is not null or rep <> last")
    reach = reach.select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    out = keys.join(reach, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out


def one_per_group(docs: DataFrame, percent: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of its component, all
    columns kept; of rows with one doc_id, one stays. Rows without a doc_id
    stay."""
    found = stored(join(docs, percent, words), "groups")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    bounded = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    left = docs.join(bounded(gone), "doc_id", "left_anti")
    again = stored(repeated, "repeated")
    if again.isEmpty():
        return left.select(docs.columns)
    again = bounded(again)
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
