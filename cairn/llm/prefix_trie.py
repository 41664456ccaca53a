"""Prefix trie of conversations as a distributed z-fast trie.

A conversation is a sequence of turns; ``fp`` of its first d turns is a 128-bit
chained digest, so equal prefixes have equal fps. The trie is compacted: a node
stands for the depths (p, e] of one edge, and is stored under its *handle*, the
prefix whose depth is the two-fattest number of (p, e] (the one with the most
trailing zero bits). ``locate`` finds where conversations leave the trie by fat
binary search: at each step a conversation probes one handle, and either goes
on below the node found or halves its depths; so it takes as many probes as the
longest conversation's length has bits, each an equi-join of all conversations
with the handle table. The child by the next turn and its edge give the exit
node and the exit depth.

``insert`` adds conversations in batches: of all that leave the trie at one
place with one next turn, the one with the smallest digest goes in, edges are
split at the exit depths, and the others are located anew. A batch halves what
is left of a place in expectation, however it branches, so batches grow with the
logarithm of the conversations that share a place.

``node_counts`` adds up subtrees by pointer doubling, in rounds logarithmic in
the height of the compacted trie. ``expand`` cuts the edges into one row a depth.

The prefixes of a conversation are kept in rows of at most ``BLOCK`` depths, so
no task needs a whole conversation, and copies of a conversation count but are
inserted once. Handles that many conversations probe are skewed join keys,
which adaptive execution splits.

Turns are ordered by turn (null first), ties by role, then text; a null role or
text is empty. Repeated rows are turns of their own. Rows without a conv_id are
left out. An empty table has no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import discard, stored
from cairn.operators.ranking import rank_within

#: Depths whose prefixes one row holds.
BLOCK = 4096
CELL = 16
ROOT = hashlib.md5(b"").digest()
#: Conversations cb, ..., cb + 4 take their first turns from conversation cb.
FAMILY, HEADS = 5, 9
#: Bytes of joined ids in one row.
CHUNK = 1 << 20


# ------------------------------------------------------------ conversations

def turns_of(table: DataFrame) -> DataFrame:
    """(conv_id, d, digest, bytes): the turns of each conversation, numbered from 1.
    ``digest`` identifies role and text, ``bytes`` is the text's length in UTF-8."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).where(F.col("conv_id").isNotNull())
    ranked = rank_within(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "d")
    size = F.octet_length("text")
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return ranked.select("conv_id", F.col("d").cast("long").alias("d"), F.unhex(F.md5(whole.cast("binary"))).alias("digest"), size.cast("long").alias("bytes"))


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their first turns: conversation c starts with the
    first h turns of conversation c - c % ``family`` and goes on with its own after
    the first h, h = crc32(c) % ``heads``. Returns the new turns and all conv_ids,
    those without turns among them."""
    turns = stored(turns, "turns")
    c, d = F.col("conv_id"), F.col("d")
    base = c - c % family
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(heads))
    convs = turns.where(d == 1).select("conv_id", base.alias("base"), h.alias("h"))
    first = turns.where((d < heads) & (c == base)).select(c.alias("base"), d.alias("at"), "digest", "bytes")
    given = convs.where(c != F.col("base")).join(first, "base").where(F.col("at") <= F.col("h"))
    own = turns.withColumns({"base": base, "h": h}).where((c == F.col("base")) | (d > F.col("h")))
    own = own.join(first.groupBy("base").agg(F.max("at").alias("n")), "base", "left")
    moved = F.when(c == F.col("base"), d).otherwise(d - F.col("h") + F.least(F.col("h"), F.coalesce("n", F.lit(0))))
    out = given.select("conv_id", F.col("at").alias("d"), "digest", "bytes").unionByName(own.select("conv_id", moved.alias("d"), "digest", "bytes"))
    return out, convs.select("conv_id")


BLOCKS = "conv_id long, block long, n int, fps binary, cum array<long>"


def _chained(block: int):
    """Per row of (conv_id, block, start, before, digests, bytes): the prefix
    digests after each turn, and the bytes up to it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps, cums, sizes = [], [], []
            for digests, counts in zip(b.column("digests").to_pylist(), b.column("bytes").to_pylist()):
                at, cells = ROOT, []
                for x in digests:
                    at = hashlib.md5(at + x).digest()
                    cells.append(at)
                fps.append(b"".join(cells))
                cums.append([0, *np.cumsum(counts).tolist()])
                sizes.append(len(cells))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), pa.array(cums, pa.list_(pa.int64()))], names=["conv_id", "block", "n", "fps", "cum"])

    return run


def _started():
    """Within one conversation, blocks in order: each block's digests depend on where it starts."""

    def run(batches):
        import pyarrow as pa

        conv, start, before = None, b"", 0
        for b in batches:
            out = []
            for c, fps, cum in zip(b.column("conv_id").to_pylist(), b.column("fps").to_pylist(), b.column("cum").to_pylist()):
                if c != conv:
                    conv, start, before = c, b"", 0
                if start:
                    fps = b"".join(hashlib.md5(start + fps[i : i + CELL]).digest() for i in range(0, len(fps), CELL))
                    cum = [x + before for x in cum]
                out.append((fps, cum))
                start, before = fps[-CELL:], cum[-1]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), b.column("n"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["conv_id", "block", "n", "fps", "cum"])

    return run


def blocks_of(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, n, fps, cum): prefixes of the depths block * ``block`` + 1, ...,
    n of them; ``cum`` has the bytes of all turns before the block, then up to each depth."""
    at = F.floor((F.col("d") - 1) / block).cast("long")
    own = F.sort_array(F.collect_list(F.struct("d", "digest", "bytes")))  # at most ``block`` turns
    rows = turns.withColumn("block", at).groupBy("conv_id", "block").agg(own.alias("t"))
    rows = stored(rows.select("conv_id", "block", F.col("t.digest").alias("digests"), F.col("t.bytes").alias("bytes")).mapInArrow(_chained(block), BLOCKS), "blocks")
    if not rows.where(F.col("block") > 0).take(1):
        return rows
    many = rows.where(F.col("block") > 0).select("conv_id").distinct()
    long = rows.join(many, "conv_id", "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_started(), BLOCKS)
    return stored(rows.join(many, "conv_id", "left_anti").unionByName(long), "blocks")


def cell(fps: Column, depth: Column, block: int) -> Column:
    """The prefix digest at ``depth`` (1 or more), out of its block."""
    return F.substring(fps, (F.pmod(depth - 1, F.lit(block)) * CELL + 1).cast("int"), F.lit(CELL))


def sequences_of(blocks: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, size, fp): length and digest of every conversation."""
    last = blocks.groupBy("conv_id").agg(F.max("block").alias("block"))
    ends = blocks.join(last, ["conv_id", "block"]).select("conv_id", (F.col("block") * block + F.col("n")).alias("size"), F.substring(F.col("fps"), (F.col("n") - 1) * CELL + 1, F.lit(CELL)).alias("fp"))
    return convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("fp", F.lit(ROOT)).alias("fp"))


# ------------------------------------------------------------ the trie

NODES = "fp binary, p long, e long, rep long, parent binary, head binary, handle binary, before long, through long"


def two_fattest(lo: Column, hi: Column) -> Column:
    """The number of (lo, hi] with the most trailing zero bits; hi > lo."""
    k = F.length(F.bin(lo.bitwiseXOR(hi))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", hi, k), k)


class Trie:
    """Compacted nodes over the prefixes ``blocks``. ``nodes`` has one row per node:
    fp of its end, depths (p, e], a conversation through it, fp of its parent's end,
    of its first depth and of its handle, bytes of the turns up to p and up to e.
    The root (depth 0) is no row."""

    def __init__(self, blocks: DataFrame, block: int = BLOCK):
        self.spark, self.blocks, self.block = blocks.sparkSession, blocks, block
        self.nodes = self.spark.createDataFrame([], NODES)
        self.empty, self.batches = True, 0
        self.one_block = not blocks.where(F.col("block") > 0).take(1)

    # prefixes ---------------------------------------------------------

    def with_cells(self, rows: DataFrame, key: list[str], conv: str, depths: dict[str, Column]) -> DataFrame:
        """Columns with ``conv``'s prefix digests at ``depths`` (null where a depth is null or 0).
        ``key`` tells rows apart."""
        if self.one_block:
            fps = self.blocks.select(F.col("conv_id").alias("_c"), F.col("fps").alias("_fps"))
            rows = rows.join(fps, F.col(conv) == F.col("_c"), "left")
            return rows.withColumns({n: F.when(d > 0, cell(F.col("_fps"), d, self.block)) for n, d in depths.items()}).drop("_c", "_fps")
        wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), d.cast("long").alias("depth")) for n, d in depths.items()]))
        asked = rows.select(*key, F.col(conv).alias("_c"), wanted.alias("w")).where(F.col("w.depth") > 0)
        asked = asked.withColumn("_b", F.floor((F.col("w.depth") - 1) / self.block).cast("long"))
        b = self.blocks.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "fps")
        got = asked.join(b, ["_c", "_b"]).select(*key, "w.name", cell(F.col("fps"), F.col("w.depth"), self.block).alias("cell"))
        found = got.groupBy(*key).agg(*[F.max(F.when(F.col("name") == n, F.col("cell"))).alias(n) for n in depths])
        return rows.join(found, key, "left")

    def probe(self, rows: DataFrame, depth: Column, name: str) -> DataFrame:
        """The rows' own prefix at ``depth``; with one block a conversation it is carried along."""
        if self.one_block:
            return rows.withColumn(name, F.when(depth > 0, cell(F.col("fps"), depth, self.block)))
        b = self.blocks.select("conv_id", F.col("block").alias("_b"), F.col("fps").alias("_fps"))
        at = F.coalesce(F.greatest(F.floor((depth - 1) / self.block), F.lit(0)), F.lit(0)).cast("long")
        rows = rows.withColumn("_b", at).join(b, ["conv_id", "_b"], "left")
        return rows.withColumn(name, F.when(depth > 0, cell(F.col("_fps"), depth, self.block))).drop("_b", "_fps")

    # search -----------------------------------------------------------

    def locate(self, rows: DataFrame, longest: int) -> DataFrame:
        """For (conv_id, size, fp) of conversations in ``blocks``, no longer than ``longest``: ``at``, the depth
        of the deepest node end on the path; ``out``, how many turns the trie shares; and
        the exit node's x_fp, x_p, x_e, x_rep (null where the path ends at a node's end)."""
        own = self.blocks.where(F.col("block") == 0).select("conv_id", "fps")
        rows = rows.join(own, "conv_id", "left") if self.one_block else rows
        if self.empty:
            return rows.withColumns({"at": F.lit(0).cast("long"), "out": F.lit(0).cast("long"), "x_fp": F.lit(None).cast("binary"), "x_p": F.lit(None).cast("long"), "x_e": F.lit(None).cast("long"), "x_rep": F.lit(None).cast("long")})
        handles = self.nodes.select(F.col("handle").alias("k"), F.col("p").alias("f_p"), F.col("e").alias("f_e"), F.col("fp").alias("f_fp"))
        lo, hi = F.col("at"), F.col("hi")
        rows = rows.withColumns({"at": F.lit(0).cast("long"), "hi": F.col("size")})
        for _ in range(max(1, longest).bit_length()):
            rows = rows.withColumn("f", F.when(lo < hi, two_fattest(lo, hi)))
            rows = self.probe(rows, F.col("f"), "k")
            # a row that is done probes a key of its own that no handle equals
            rows = rows.withColumn("k", F.coalesce("k", F.concat(F.col("fp"), F.lit(b"\0"))))
            rows = rows.join(handles, "k", "left")
            rows = self.probe(rows, F.when(F.col("f_e") <= F.col("size"), F.col("f_e")), "own")
            whole, met = F.coalesce(F.col("own") == F.col("f_fp"), F.lit(False)), F.col("f_e").isNotNull()
            done = lo >= hi
            rows = rows.withColumns({
                "at": F.when(done, lo).when(whole, F.col("f_e")).when(met, F.col("f_p")).otherwise(lo),
                "hi": F.when(done, lo).when(whole, hi).when(met, F.col("f_p")).otherwise(F.col("f") - 1)}).drop("f", "k", "own", "f_p", "f_e", "f_fp")
        rows = self.probe(rows.drop("hi"), F.when(lo < F.col("size"), lo + 1), "k").withColumn("k", F.coalesce("k", F.concat(F.col("fp"), F.lit(b"\0"))))
        below = self.nodes.select(F.col("head").alias("k"), F.col("fp").alias("x_fp"), F.col("p").alias("x_p"), F.col("e").alias("x_e"), F.col("rep").alias("x_rep"))
        return self._shared(rows.join(below, "k", "left").drop("k"))

    def _shared(self, rows: DataFrame) -> DataFrame:
        """``out`` by comparing prefixes along the exit node's edge, block by block."""
        to = F.least("size", "x_e")
        number = lambda d: F.floor((d - 1) / self.block).cast("long")
        rep = self.blocks.select(F.col("conv_id").alias("x_rep"), F.col("block").alias("_b"), F.col("fps").alias("_theirs"))
        if self.one_block:
            # a row without an exit edge meets its own prefixes
            theirs = rep.select(F.col("x_rep").alias("_r"), "_theirs")
            on = rows.withColumn("_r", F.coalesce("x_rep", "conv_id")).join(theirs, "_r").withColumn("_mine", F.col("fps"))
            first, last = F.col("x_p") + 1, to
        else:
            mine = self.blocks.select("conv_id", F.col("block").alias("_b"), F.col("fps").alias("_mine"))
            spread = F.explode(F.sequence(number(F.col("x_p") + 1), number(to)))
            on = rows.where(F.col("x_p").isNotNull()).select("conv_id", "size", "x_p", "x_e", "x_rep", spread.alias("_b")).join(mine, ["conv_id", "_b"]).join(rep, ["x_rep", "_b"])
            base = F.col("_b") * self.block
            first, last = F.greatest(F.col("x_p") + 1, base + 1), F.least(to, base + self.block)
        equal = F.size(F.filter(F.sequence(first, last), lambda d: cell(F.col("_mine"), d, self.block) == cell(F.col("_theirs"), d, self.block)))
        if self.one_block:
            return on.withColumn("out", F.col("at") + F.when(F.col("x_p").isNotNull(), equal).otherwise(0)).drop("_r", "_mine", "_theirs")
        n = on.groupBy("conv_id").agg(F.sum(equal).alias("_n"))
        return rows.join(n, "conv_id", "left").withColumn("out", F.col("at") + F.coalesce("_n", F.lit(0))).drop("_n")

    # insertion --------------------------------------------------------

    def insert(self, sequences: DataFrame) -> "Trie":
        """Adds (conv_id, size, fp), conversations of ``blocks``, each fp once. Batches until all are in."""
        todo = sequences.where(F.col("size") > 0)
        own = False
        while True:
            longest = todo.agg(F.max("size")).first()[0]
            if longest is None:
                return self
            located = stored(self.locate(todo, int(longest)), "located")
            # those that end at a node's end are in
            rest = located.where(F.col("out") < F.col("size"))
            ending = located.where((F.col("out") == F.col("size")) & (F.col("at") < F.col("size")))  # inside an edge
            cols = ["conv_id", "size", "fp", "at", "out", "x_fp", "x_p", "x_e", "x_rep"]
            rest = self.probe(rest, F.col("out") + 1, "slot")
            taken = F.min(F.struct("fp", *[c for c in cols if c != "fp"]))
            winners = rest.groupBy("slot").agg(taken.alias("w")).select("w.*").select(cols)
            winners = stored(winners.unionByName(ending.select(cols)), "winners")
            before, left = self.nodes, todo
            self._grow(winners)
            left_over = rest.select("conv_id", "size", "fp").join(winners.select("conv_id"), "conv_id", "left_anti")
            todo = stored(left_over, "left")
            self.batches += 1
            for done in (located, winners, before if self.batches > 1 else None, left if own else None):
                discard(done)
            own = True

    def _grow(self, winners: DataFrame) -> None:
        """Nodes with the edges of the batch: leaves, nodes at exit depths inside an edge, and what stays of the edges below."""
        cut = winners.where(F.col("x_p").isNotNull())
        points = cut.groupBy("x_fp", "out").agg(F.min(F.struct("conv_id", "x_p", "x_e", "x_rep")).alias("w")).select("x_fp", "out", "w.*")
        along = Window.partitionBy("x_fp").orderBy("out")
        upper = points.select(F.col("conv_id").alias("rep"), F.coalesce(F.lag("out").over(along), F.col("x_p")).alias("p"), F.col("out").alias("e"))
        lower = points.groupBy("x_fp").agg(F.max("out").alias("p"), F.min("x_e").alias("e"), F.min("x_rep").alias("rep")).select("rep", "p", "e")
        leaves = winners.where(F.col("out") < F.col("size")).select(F.col("conv_id").alias("rep"), F.col("out").alias("p"), F.col("size").alias("e"))
        new = self.finished(leaves if self.empty else leaves.unionByName(upper).unionByName(lower))
        old = self.nodes.join(cut.select(F.col("x_fp").alias("fp")).distinct(), "fp", "left_anti")
        self.nodes = stored(new if self.empty else old.unionByName(new), "nodes")
        self.empty = False

    def finished(self, spans: DataFrame) -> DataFrame:
        """Nodes for (rep, p, e): digests and byte counts from rep's prefixes."""
        p, e = F.col("p"), F.col("e")
        rows = spans.select(F.col("rep").cast("long").alias("rep"), p.cast("long").alias("p"), e.cast("long").alias("e"))
        rows = self.with_cells(rows, ["rep", "p", "e"], "rep", {"parent": p, "head": p + 1, "handle": two_fattest(p, e), "fp": e})
        rows = rows.withColumn("parent", F.coalesce("parent", F.lit(ROOT)))
        for name, d in (("before", p), ("through", e)):
            cum = self.blocks.select(F.col("conv_id").alias("rep"), F.col("block").alias("_b"), F.col("cum").alias("_cum"))
            rows = rows.withColumn("_b", F.greatest(F.floor((d - 1) / self.block), F.lit(0)).cast("long")).join(cum, ["rep", "_b"])
            rows = rows.withColumn(name, F.when(d > 0, F.element_at("_cum", (F.pmod(d - 1, F.lit(self.block)) + 2).cast("int"))).otherwise(F.lit(0).cast("long"))).drop("_b", "_cum")
        return rows.select([c.split()[0] for c in NODES.split(", ")])


# ------------------------------------------------------------ counts

def node_counts(trie: Trie, members: DataFrame) -> DataFrame:
    """Every compacted node (the root with depths (-1, 0] too) with figures of its
    subtree: n_convs, conv_id (smallest member), n_leaves, weighted (bytes of all
    members), plain (bytes of all edges); and n_children of its end.

    ``members`` is (conv_id, size, fp), all conversations. Sums go up by pointer
    doubling: after k rounds a node holds the sums of all nodes fewer than 2^k
    below, and a pointer to the node 2^k above."""
    spark = trie.spark
    root = spark.createDataFrame([(ROOT, -1, 0, 0, 0)], "fp binary, p long, e long, before long, through long")
    shape = trie.nodes.select("fp", "p", "e", "before", "through", "parent", "rep")
    shape = root.withColumns({"parent": F.lit(None).cast("binary"), "rep": F.lit(None).cast("long")}).select(shape.columns).unionByName(shape)
    ends = members.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    kids = trie.nodes.groupBy(F.col("parent").alias("fp")).agg(F.count(F.lit(1)).alias("n_children"))
    rows = shape.join(ends, "fp", "left").join(kids, "fp", "left")
    zero = F.lit(0).cast("long")
    n = F.coalesce("n", zero)
    rows = rows.select(*shape.columns, F.coalesce("n_children", zero).alias("n_children"), F.col("parent").alias("jump"), n.alias("n_convs"), F.col("least").alias("conv_id"),
                       F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
                       (n * F.col("through")).alias("weighted"), (F.col("through") - F.col("before")).alias("plain"))
    rows = stored(rows, "counts")
    sums = ["n_convs", "n_leaves", "weighted", "plain"]
    while rows.where(F.col("jump").isNotNull()).take(1):
        up = rows.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("fp")).agg(*[F.sum(c).alias(f"_{c}") for c in sums], F.min("conv_id").alias("_least"))
        over = rows.select(F.col("fp").alias("jump"), F.col("jump").alias("_next"))
        # a row that points nowhere meets itself
        after = rows.join(up, "fp", "left").withColumn("jump", F.coalesce("jump", "fp")).join(over, "jump")
        after = after.select(*shape.columns, "n_children", F.col("_next").alias("jump"), *[(F.col(c) + F.coalesce(f"_{c}", zero)).alias(c) for c in sums], F.least("conv_id", "_least").alias("conv_id"))
        last, rows = rows, stored(after, "counts")
        discard(last)
    return rows.drop("jump")


def expand(trie: Trie, counts: DataFrame) -> DataFrame:
    """One row per depth of every edge: fp (of the edge's end where the depth is that
    end, else null), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens."""
    above = counts.select(F.col("fp").alias("parent"), F.col("conv_id").alias("above"))
    rows = counts.where(F.col("e") > 0).join(above, "parent")
    block = trie.block
    number = lambda d: F.floor((d - 1) / block).cast("long")
    rows = rows.withColumn("block", F.explode(F.sequence(number(F.col("p") + 1), number(F.col("e")))))
    rows = rows.join(trie.blocks.select(F.col("conv_id").alias("rep"), "block", "cum"), ["rep", "block"])
    base = F.col("block") * block
    rows = rows.withColumn("d", F.explode(F.sequence(F.greatest(F.col("p"), base) + 1, F.least(F.col("e"), base + block))))
    done = F.element_at("cum", (F.col("d") - base).cast("int"))  # bytes before the turn at d
    end = F.col("d") == F.col("e")
    # members' bytes from d on, less one copy of each turn there
    saved = F.col("weighted") - F.col("n_convs") * done - (F.col("plain") - (done - F.col("before")))
    return rows.select(F.when(end, F.col("fp")).alias("fp"), "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == F.col("p") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                       "n_convs", F.when(end, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"))


# ------------------------------------------------------------ ends

def _chunks(limit: int):
    """Joined ids of runs of one fp in sorted rows, in rows of about ``limit`` bytes."""

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("fp", pa.binary()), ("least", pa.int64()), ("ids", pa.string())])
        held, fp, n = [], None, 0

        def row():
            return pa.RecordBatch.from_pylist([{"fp": fp, "least": held[0], "ids": ",".join(map(str, held))}], kind)

        for b in batches:
            for f, c in zip(b.column("fp").to_pylist(), b.column("conv_id").to_pylist()):
                if held and (f != fp or n >= limit):
                    yield row()
                    held, n = [], 0
                fp = f
                held.append(c)
                n += len(str(c)) + 1
        if held:
            yield row()

    return run


def _hashed(batches):
    import pyarrow as pa

    kind = pa.schema([("fp", pa.binary()), ("ends_sha256", pa.string())])
    fp, h = None, None
    for b in batches:
        out = []
        for f, ids in zip(b.column("fp").to_pylist(), b.column("ids").to_pylist()):
            if f != fp:
                if fp is not None:
                    out.append({"fp": fp, "ends_sha256": h.hexdigest()})
                fp, h = f, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist(out, kind)
    if fp is not None:
        yield pa.RecordBatch.from_pylist([{"fp": fp, "ends_sha256": h.hexdigest()}], kind)


def ends_digest(members: DataFrame, partitions: int, chunk: int = CHUNK) -> DataFrame:
    """(fp, ends_sha256) of each distinct conversation: the ids of its copies in
    order. Ids are joined range by range; only the joined text of one conversation
    meets in a task, which reads it as a stream, as the digest needs it in order."""
    ranges = members.select("fp", "conv_id").repartitionByRange(partitions, "fp", "conv_id").sortWithinPartitions("fp", "conv_id")
    joined = ranges.mapInArrow(_chunks(chunk), "fp binary, least long, ids string")
    return joined.repartition("fp").sortWithinPartitions("fp", "least").mapInArrow(_hashed, "fp binary, ends_sha256 string")


# ------------------------------------------------------------ whole runs

def build(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> tuple[Trie, DataFrame]:
    """The trie of conversations (turns as of ``turns_of``; ``convs`` their ids, with those
    that have no turn), and its members (conv_id, size, fp)."""
    blocks = blocks_of(turns, block)
    members = stored(sequences_of(blocks, convs, block), "members")
    distinct = members.groupBy("fp", "size").agg(F.min("conv_id").alias("conv_id"))
    reps = stored(distinct.select("conv_id", "size", "fp"), "sequences")
    kept = stored(blocks.join(reps.select("conv_id"), "conv_id", "left_semi"), "blocks")
    discard(blocks)
    return Trie(kept, block).insert(reps), members


def report(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix (depth-level node); see ``expand``, with ends_sha256."""
    trie, members = build(turns, convs, block)
    counts = node_counts(trie, members)
    top = counts.where((F.col("e") == 0) & F.col("conv_id").isNotNull())
    spark = trie.spark
    none = hashlib.sha256(b"").hexdigest()
    root = top.select("fp", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("weighted") - F.col("plain")).alias("saved_tokens"))
    ends = ends_digest(members, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # depths inside an edge get a key of their own, so that they don't meet in one task
    key = F.coalesce("fp", F.unhex(F.md5(F.concat_ws(":", "conv_id", "depth").cast("binary"))))
    out = expand(trie, counts).unionByName(root).withColumn("fp", key).join(ends, "fp", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
