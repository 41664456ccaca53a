"""Connected components of a table of links, by repeated contraction.

Each round deals new ranks to the vertices, by a hash of id and round. Every
vertex points to the lowest in rank of itself and its neighbours, pointers are
followed ``JUMPS`` times over (twice as far each time), links are moved to what
their ends point to, and links within one vertex go. A vertex with neighbours
stays its own with a chance of one half at most, whatever the graph and however
its ids run, so the vertices with links left shrink by half or more a round:
the rounds grow with the logarithm of the largest component. Each round is
written to the shared folder. As soon as at most ``ONE_TASK`` links are left,
one task finishes them with a union-find, which gives the same components (that
many links are a few megabytes, whatever the input). Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, stored

ONE_TASK = 100_000
#: Times the pointers of a round are doubled.
JUMPS = 2


def _union_find(batches):
    import pyarrow as pa

    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            p, q = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(p, q)] = min(p, q)
    ids = sorted(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["id", "to"])


def _pointers(links: DataFrame, turn: int) -> DataFrame:
    """(id, to): of a vertex and its neighbours the one that comes first in this round."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
    rank = lambda v: F.struct(F.xxhash64(F.lit(turn), v).alias("rank"), F.col(v).alias("to"))
    first = both.groupBy("id").agg(F.min(rank("to")).alias("first"))
    return first.select("id", F.least("first", rank("id"))["to"].alias("to"))


def _by_smallest(label: DataFrame) -> DataFrame:
    """Components under the name of their smallest id."""
    name = label.groupBy("component").agg(F.min("id").alias("smallest"))
    out = stored(label.join(name, "component").select("id", F.col("smallest").alias("component")), "label")
    discard(label)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``links`` (a, b: long): the smallest
    id reachable. Links may repeat, point both ways or to themselves; links
    with a null end are left out."""
    links = links.where("a is not null and b is not null")
    left = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label, turn = None, 0
    while True:
        last = left.count() <= ONE_TASK
        point = stored(left.repartition(1).mapInArrow(_union_find, "id long, to long") if last else _pointers(left, turn), "point")
        for _ in range(0 if last else JUMPS):
            on = point.select(F.col("id").alias("to"), F.col("to").alias("on"))
            near, point = point, stored(point.join(on, "to").select("id", F.col("on").alias("to")), "point")
            discard(near)
        before = label
        if label is None:
            label = point.select("id", F.col("to").alias("component"))
            label.stored_path = point.stored_path
        else:
            p = point.select(F.col("id").alias("component"), F.col("to").alias("next"))
            label = stored(label.join(p, "component", "left").select("id", F.coalesce("next", "component").alias("component")), "label")
            discard(before)
        if last:
            discard(left, point if turn else None)
            return _by_smallest(label) if turn else label
        a, b = point.select(F.col("id").alias("a"), F.col("to").alias("x")), point.select(F.col("id").alias("b"), F.col("to").alias("y"))
        links, left = left, stored(left.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(links, point if turn else None)
        turn += 1
