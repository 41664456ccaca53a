import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import prefix_trie as T
from cairn.llm.queries import op11_zfast_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NONE = hashlib.sha256(b"").hexdigest()


def original(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def rebuilt(rows):
    own = original(rows)
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = own + sum(saved[k] for k in kids[p])
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha))
    return sorted(out, key=lambda r: r[:2])


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def frame(spark, convs):
    """Turn table of {conv_id: [(role, text)]}."""
    return spark.createDataFrame([(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)], SCHEMA)


def trie_of(spark, convs, block=T.BLOCK):
    turns = T.turns_of(frame(spark, convs))
    return T.report(turns, turns.select("conv_id").distinct(), block)


ROWS = [(c, t, ("user", "assistant")[t % 2], f"text é {(c // 10) * (t > 1)} {c * (t > 3)}") for c in range(40) for t in range(c % 7 + 1)]
ODD = [(None, 0, "user", "x"), (50, None, None, None), (50, 0, "user", ""), (50, 0, None, "z"), (50, 0, None, "z"), (51, None, "a", "b"), (51, None, "a", "a"), (52, 3, "user", "only"), (57, 0, "user", "base missing"), (58, 1, "user", "b" * 70000)]


def test_two_fattest(spark):
    rows = [(lo, hi) for hi in range(1, 70) for lo in range(hi)]
    for r in spark.createDataFrame(rows, "lo long, hi long").withColumn("f", T.two_fattest(F.col("lo"), F.col("hi"))).collect():
        assert r["f"] == max(range(r["lo"] + 1, r["hi"] + 1), key=lambda x: x & -x)
    assert spark.range(1).select(T.two_fattest(F.lit(2**40 - 1), F.lit(2**40 + 5))).first()[0] == 2**40


@pytest.mark.parametrize("block", [T.BLOCK, 2])
def test_report_equals_plain_version(spark, block):
    df = spark.createDataFrame(ROWS + ODD, SCHEMA).selectExpr("*", "1 as fp", "2 as d", "3 as block").repartition(3)
    turns, convs = T.rebuilt(T.turns_of(df))
    assert got(T.report(turns, convs, block)) == nodes(rebuilt(ROWS + ODD))


def test_random_tries_by_small_alphabets(spark):
    rng = random.Random(5)
    convs = {c: [("u", rng.choice("ab")) for _ in range(rng.randint(1, 9))] for c in range(150)}
    assert got(trie_of(spark, convs)) == nodes(convs)


def test_copies_prefixes_and_a_chain(spark):
    long = [("u", str(i)) for i in range(70)]
    convs = {c: long[: c % 35 * 2 + 1] for c in range(70)}  # each ends inside another's edge
    convs |= {100 + c: long for c in range(30)}  # copies
    convs |= {200 + c: long[:c] + [("u", f"off{c}")] for c in range(0, 60, 3)}  # one branch at many depths
    turns = T.turns_of(frame(spark, convs))
    trie, members = T.build(turns, turns.select("conv_id").distinct(), 16)
    assert got(T.report(turns, turns.select("conv_id").distinct(), 16)) == nodes(convs)
    assert trie.batches <= 16  # 55 distinct conversations share one place
    ends = {tuple(r) for r in trie.nodes.select("p", "e").collect()}
    assert all(p < e for p, e in ends) and trie.nodes.select("handle").distinct().count() == trie.nodes.count()


def test_insert_in_batches_equals_one_build(spark):
    rng = random.Random(6)
    convs = {c: [("u", rng.choice("abc")) for _ in range(rng.randint(1, 6))] for c in range(60)}
    turns = T.turns_of(frame(spark, convs))
    ids = turns.select("conv_id").distinct()
    whole, members = T.build(turns, ids)
    reps = members.groupBy("fp", "size").agg(F.min("conv_id").alias("conv_id")).select("conv_id", "size", "fp")
    trie = T.Trie(whole.blocks)
    for k in range(3):
        trie.insert(reps.where(F.pmod("conv_id", F.lit(3)) == k))
    spans = lambda t: {(bytes(r["fp"]), r["p"], r["e"], bytes(r["handle"])) for r in t.nodes.collect()}
    assert spans(trie) == spans(whole)
    # everything inserted is found at its own end
    assert trie.locate(reps, 6).where("at <> size or out <> size").count() == 0


def test_locate_finds_exit_depths(spark):
    stored = {0: [("u", x) for x in "abcdefgh"], 1: [("u", x) for x in "abcdxy"]}
    asked = {10: "abcdefgh", 11: "abcdeZ", 12: "abZ", 13: "Z", 14: "abcd", 15: "abcdxyz", 16: "abcdef", 17: "abcdq"}
    turns = T.turns_of(frame(spark, stored | {c: [("u", x) for x in s] for c, s in asked.items()}))
    ids = turns.select("conv_id").distinct()
    blocks = T.blocks_of(turns)
    seqs = T.sequences_of(blocks, ids)
    trie = T.Trie(blocks).insert(seqs.where("conv_id < 10"))
    out = {r["conv_id"]: (r["at"], r["out"]) for r in trie.locate(seqs.where("conv_id >= 10"), 8).collect()}
    assert out == {10: (8, 8), 11: (4, 5), 12: (0, 2), 13: (0, 0), 14: (4, 4), 15: (6, 6), 16: (4, 6), 17: (4, 4)}


def test_ends_of_many_copies_in_small_chunks(spark):
    members = spark.createDataFrame([(i * 7 % 1000, b"a" if i % 3 else b"b") for i in range(1000)], "conv_id long, fp binary")
    want = {f: hashlib.sha256(",".join(map(str, sorted(i * 7 % 1000 for i in range(1000) if (b"a" if i % 3 else b"b") == f))).encode()).hexdigest() for f in (b"a", b"b")}
    assert {bytes(r["fp"]): r["ends_sha256"] for r in T.ends_digest(members, 5, chunk=40).collect()} == want


def test_turnless_and_empty(spark):
    rows = [(1, 0, "user", "gone")]  # conversation 0 is absent, h(1) > 1: nothing is left
    assert zlib.crc32(b"1") % 9 >= 1
    turns, convs = T.rebuilt(T.turns_of(spark.createDataFrame(rows, SCHEMA)))
    assert got(T.report(turns, convs)) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    for none in ([], [(None, 1, "user", "x")]):
        turns, convs = T.rebuilt(T.turns_of(spark.createDataFrame(none, SCHEMA)))
        assert T.report(turns, convs).count() == 0


def test_query_columns(spark):
    df = op11_zfast_trie(spark, "/root/testdata/sf0.001")
    assert df.dtypes == [("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string")]
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == nodes(rebuilt(rows))
