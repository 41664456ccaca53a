"""Links between rows that share a token, as components, without all pairs.

``posts`` (token, id, n; with their counts as size, or all of them) says which ids hold which tokens; ``payload``
(id, n, payload) is what a similarity compares. Every pair of ids that share a
token and whose sizes ``n`` are within ``percent`` of each other is a
candidate, and no linked candidate is lost between different components:

1. In some turns the ids of each token are compared with one leader (as many rows
   as posts at most), another one each time, and what is linked is joined.
2. Tokens whose ids still lie in several components: small groups are compared
   as pairs of ids across components; larger ones in tasks of two cells of
   about ``cell`` ids each (dealt by size class and hash), which hand back only
   links that join something new.

What this shuffles at once is bounded: candidates are made of some tokens at a time,
and where their payloads are more than ``LEAST`` and ``SHARE`` of all payloads, they
are compared in turns, each of the links of a slice of the ids with another. A turn's
links are stored, and its shuffle files go, before the next one begins.

Posts may carry 128 bits of a sketch (s0, s1; null where it says nothing): then only
ids whose sketches differ in at most ``far`` bits are candidates. They may also carry
counts of letter pairs (p0 to p3, or null), which rule out only what can't be similar by
edits (``apart_by_counts``).

The similarity object has ``load(raw)``, ``tokens(item)`` and ``linked(a, b)``, and
possibly ``load_all(raws)`` for items that are compared with one another, and
``linked_all(xs, ys)`` for many pairs of raw items at once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, stored, tidy
from cairn.llm.components import components

#: Leaders each token has in turn; what they join need not be compared in pairs.
TURNS = 2
#: Bytes that a turn of comparisons may shuffle, and as a share of all payloads; the larger counts.
LEAST, SHARE = 512 << 20, 1.25
#: Pairs made at once, and for each post; the larger counts.
PAIRS, PAIRS_A_POST = 1 << 25, 16


def _compare(shared):
    """Of candidates with both payloads, those that are linked."""

    def run(batches):
        import pyarrow as pa

        sim, last, y = shared.value, None, None
        for batch in batches:
            a, b, x, own = (batch.column(c).to_pylist() for c in ("a", "b", "mine", "own"))
            keep = []
            if hasattr(sim, "linked_all"):
                keep = [k for k, ok in enumerate(sim.linked_all(x, own)) if ok]
                x = ()
            for k in range(len(x)):
                if own[k] != last:  # sorted by b, so mostly the one before
                    last, y = own[k], sim.load(own[k])
                if sim.linked(sim.load(x[k]), y):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    return tidy(run)


def verified(pairs: DataFrame, payload: DataFrame, shared, slices: int = 1, i: int = 0, j: int = 0) -> DataFrame:
    """The pairs (a, b) that are linked; of ``slices`` of the ids, those of an a in slice i and a b in slice j."""
    within = lambda c, k: F.pmod(F.xxhash64(c), F.lit(slices)) == k if slices > 1 else F.lit(True)
    # both sides are projected alike, so one exchange serves both if they are the same slice
    mine = payload.where(within("id", i)).select(F.col("id").alias("a"), F.col("payload").alias("mine"))
    own = payload.where(within("id", j)).select(F.col("id").alias("b"), F.col("payload").alias("own"))
    left = pairs.where(within("a", i) & within("b", j)).select("a", "b").join(mine, "a")
    return left.join(own, "b").select("a", "b", "mine", "own").mapInArrow(_compare(shared), "a long, b long").distinct()


class Payloads:
    """A table (id, n, payload) and its size; ``limit`` is what a turn may shuffle."""

    def __init__(self, table: DataFrame):
        r = table.agg(F.sum(F.octet_length("payload")), F.sum("n")).first()
        self.table, self.size = table, r[0] or 0
        self.unit = self.size / max(1, r[1] or 0)
        self.limit = max(LEAST, SHARE * self.size)

    def slices(self, pairs: int, n: int) -> int:
        """Slices of the ids so that the pairs of two slices, whose a have ``n`` in all, stay within the limit."""
        k, moved = 1, pairs * 24 + n * self.unit
        while (2 if k > 1 else 1) * self.size / k + moved / k**2 > self.limit and k < 64:
            k += 1
        return k


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _linked(pairs: DataFrame, payload: Payloads, shared) -> list[DataFrame]:
    """Stored links among candidates (a, b, n of a)."""
    pairs = stored(pairs, "pairs")
    rows, n = pairs.agg(F.count(F.lit(1)), F.sum("n")).first()
    k = payload.slices(rows, n or 0)
    out = [stored(verified(pairs, payload.table, shared, k, i, j), "found") for i in range(k) for j in range(k)]
    discard(pairs)
    return out


def apart_by_counts(percent: int):
    """Whether two texts of n and m letters can't have an edit similarity of ``percent``, by
    their counts: of 128 bins of letter pairs, how many they hold, up to 3, in two
    planes of bits (p0, p1 the high ones, p2, p3 the low ones; q0 to q3 of the other text).
    An edit changes counts by 4 in all, one that changes the length by 3, and bins and the
    bound can only bring them closer."""
    differ = F.lit(0)
    for k in (0, 1):
        high, low, high2, low2 = (F.col(f"{c}{x}") for c in "pq" for x in (k, k + 2))
        for x, y in ((high.bitwiseOR(low), high2.bitwiseOR(low2)), (high, high2), (high.bitwiseAND(low), high2.bitwiseAND(low2))):
            differ += F.bit_count(x.bitwiseXOR(y))
    longer = F.greatest("n", "m")
    return differ > 4 * F.floor(longer * (100 - percent) / 100) - (longer - F.least("n", "m"))


def _cell_links(shared):
    """Links between ids of different components in one or two cells; links
    that join nothing new within the task are left out."""

    def run(key, pdf):
        import pandas as pd

        sim = shared.value
        items = sim.load_all(pdf["payload"]) if hasattr(sim, "load_all") else [sim.load(x) for x in pdf["payload"]]
        comp, side, ids = pdf["component"].tolist(), pdf["side"].tolist(), pdf["id"].tolist()
        index: dict[int, list[int]] = {}
        root = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        alone = key[1] == key[2]
        out = []
        for i, item in enumerate(items):
            tokens = sim.tokens(item)
            for j in sorted({j for t in tokens for j in index.get(t, ())}):
                if (alone or side[i] != side[j]) and find(comp[i]) != find(comp[j]) and sim.linked(item, items[j]):
                    out.append((ids[i], ids[j]))
                    root[find(comp[i])] = find(comp[j])
            for t in tokens:
                index.setdefault(t, []).append(i)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _cells(rows: DataFrame, percent: int, cell: int) -> DataFrame:
    """Rows (id, n, component, family) dealt to tasks (family, x, y) of two
    cells, so that any two of similar size and one family meet in one."""
    # the size class: similar sizes lie in one class or in two beside each other
    rows = rows.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int"))
    cells = rows.groupBy("family", "cls").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells"))
    above = cells.select("family", (F.col("cls") - 1).alias("cls"), F.col("cells").alias("above"))
    below = cells.select("family", (F.col("cls") + 1).alias("cls"), F.col("cells").alias("below"))
    rows = rows.join(cells, ["family", "cls"]).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    rows = rows.join(above, ["family", "cls"], "left").join(below, ["family", "cls"], "left")
    name = lambda c, k: F.concat_ws("/", c.cast("string"), k.cast("string"))
    task = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    to = lambda z: F.when(F.coalesce(z, F.lit(0)) > 0, F.sequence(F.lit(0), F.coalesce(z, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    cls, own = F.col("cls"), name(F.col("cls"), F.col("cell"))
    tasks = F.concat(F.transform(to(F.col("cells")), lambda k: task(name(cls, F.least(k, F.col("cell"))), name(cls, F.greatest(k, F.col("cell"))))),
                     F.transform(to(F.col("above")), lambda k: task(own, name(cls + 1, k))),
                     F.transform(to(F.col("below")), lambda k: task(name(cls - 1, k), own)))
    return rows.withColumn("task", F.explode(tasks)).select("family", F.col("task.x").alias("x"), F.col("task.y").alias("y"), "id", "n", "component", own.alias("side"))


def _linked_in_cells(rows: DataFrame, payload: Payloads, shared, percent: int, cell: int) -> list[DataFrame]:
    """Stored links among rows (id, n, component, family) of one family."""
    dealt = _cells(rows, percent, cell)
    n = dealt.agg(F.sum("n")).first()[0] or 0
    turns = max(1, math.ceil(n * payload.unit / payload.limit))
    out = []
    for k in range(turns):
        own = dealt if turns == 1 else dealt.where(F.pmod(F.xxhash64("family", "x", "y"), F.lit(turns)) == k)
        own = own.drop("n").join(payload.table.select("id", "payload"), "id")
        out.append(stored(own.groupBy("family", "x", "y").applyInPandas(_cell_links(shared), "a long, b long"), "found"))
    return out


def group_links(posts: DataFrame, payload: DataFrame, shared, percent: int, small: int, cell: int, far: int = 0, turns: int = TURNS) -> DataFrame:
    """(id, component) of all ids that are linked with another; the component
    is its smallest id. ``shared`` is the broadcast similarity object."""
    own = "size" not in posts.columns
    if own:
        sizes = posts.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        posts = stored(posts.join(sizes, "token"), "posts")
    similar = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("a") != F.col("b"))
    sketch = [c for c in ("s0", "s1", "p0", "p1", "p2", "p3") if c in posts.columns]
    other = {c: {"s": "t", "p": "q"}[c[0]] + c[1] for c in sketch}
    if "s0" in sketch:
        similar &= ~F.coalesce(F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) > far, F.lit(False))
    if "p0" in sketch:
        similar &= ~F.coalesce(apart_by_counts(percent), F.lit(False))

    def with_component(label):
        """Posts with their components, dealt by token: what is summed up for a token joins them without being dealt again."""
        now = posts.withColumn("component", F.col("id")) if label is None else posts.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # nothing is null here; said so that both uses read one exchange
        return now.where("token is not null and id is not null and component is not null").repartition("token")

    payload, found, label = Payloads(payload), None, None
    for turn in range(turns):
        now = with_component(label)
        lead = now.groupBy("token").agg(F.min_by(F.struct("id", "n", "component", *sketch), F.struct(F.xxhash64(F.lit(turn), "id"), F.col("id"))).alias("lead"),
                                        F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
        star = now.join(lead, "token").where(F.col("component") != F.col("lead.component"))
        star = star.select(F.col("id").alias("a"), "n", F.col("lead.id").alias("b"), F.col("lead.n").alias("m"), *sketch, *[F.col(f"lead.{c}").alias(other[c]) for c in sketch]).where(similar).select("a", "b", "n").distinct()
        found = (found or []) + _linked(star, payload, shared)
        label = components(_union(found))

    # tokens whose ids lie in several components
    now = with_component(label)
    split = now.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token")
    now = stored(now.join(split, "token"), "split")
    few, many = now.where(F.col("size") <= small), now.where(F.col("size") > small)
    x = few.select("token", F.col("id").alias("a"), "n", F.col("component").alias("ca"), *sketch)
    y = few.select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("cb"), *[F.col(c).alias(other[c]) for c in sketch])
    posted, most = few.agg(F.count(F.lit(1)), F.sum(F.col("size") - 1)).first()
    turns = max(1, math.ceil((most or 0) / 2 / max(PAIRS, PAIRS_A_POST * posted)))
    new = []
    for k in range(turns):
        ours, theirs = (t if turns == 1 else t.where(F.pmod(F.xxhash64("token"), F.lit(turns)) == k) for t in (x, y))
        pairs = ours.join(theirs, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).where(similar).select("a", "b", "n").distinct()
        new += _linked(pairs, payload, shared)
    if not many.isEmpty():
        # families: ids joined by tokens of large groups
        lead = many.groupBy("token").agg(F.min("id").alias("b"))
        family = components(many.join(lead, "token").select(F.col("id").alias("a"), "b")).withColumnRenamed("component", "family")
        rows = stored(many.select("id", "n", "component").distinct().join(family, "id"), "families")
        new += _linked_in_cells(rows, payload, shared, percent, cell)
        discard(family, rows)
    out = components(_union(found + new))
    discard(now, posts if own else None, *found, *new)
    return out
