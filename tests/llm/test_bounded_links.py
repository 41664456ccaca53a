"""What linking leaves on disk and shuffles at once, and that it loses no link by that."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import common, group_links, line_dedup, ngram_join
from tests.llm.test_line_dedup import brute, corpus


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in found.split("\n") if "/shuffle_" in x}


def test_stored_tables_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    t = common.stored(spark.range(10_000).withColumn("k", F.col("id") % 7).repartition(4, "id").groupBy("k").count(), "sums")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert t.count() == 7 and spark.conf.get(common.CLEANUP, None) == setting


def edited(rng, text, edits, letters):
    text = list(text)
    for _ in range(edits):
        k, what = rng.randrange(len(text) + 1), rng.randrange(3)
        if what == 0 or k == len(text):
            text.insert(k, rng.choice(letters))
        elif what == 1 and len(text) > 2:
            del text[k]
        else:
            text[k] = rng.choice(letters)
    return " ".join("".join(text).split()) or "a"


def test_counts_of_letter_pairs_rule_out_no_similar_lines(spark):
    rng, rows, ruled_out = random.Random(5), [], 0
    for k in range(1500):
        letters = rng.choice(["ab ", "abcdefgh ", "aeiou漢字 0"])
        a = edited(rng, "x", rng.randint(1, 120), letters)
        b = edited(rng, a, rng.randint(0, len(a) // 4 + 1), letters) if k % 3 else edited(rng, "y", len(a), letters)
        most = max(len(a), len(b)) * 20 // 100
        rows.append((k, len(a), len(b), line_dedup.distance(a, b, most) <= most, a, b))
    x, y = (line_dedup.Lines.of([r[c] for r in rows]).pair_counts().tolist() for c in (4, 5))
    t = spark.createDataFrame([(*r[:4], *p, *q) for r, p, q in zip(rows, x, y)], "k long, n long, m long, similar boolean, " + ", ".join(f"{c}{i} long" for c in "pq" for i in range(4)))
    got = t.select("similar", group_links.apart_by_counts(80).alias("apart")).collect()
    assert sum(r.similar for r in got) > 500
    assert not any(r.similar and r.apart for r in got)
    assert sum(r.apart for r in got) > 200


@pytest.fixture()
def in_turns(monkeypatch):
    """Comparisons in many small turns; gives how many pairs each of them had."""
    seen, verified = [], group_links.verified

    def counted(pairs, payload, shared, *where):
        seen.append(where)
        return verified(pairs, payload, shared, *where)

    monkeypatch.setattr(group_links, "LEAST", 1)
    monkeypatch.setattr(group_links, "SHARE", 1)
    monkeypatch.setattr(group_links, "PAIRS", 400)
    monkeypatch.setattr(group_links, "PAIRS_A_POST", 0)
    monkeypatch.setattr(group_links, "verified", counted)
    return seen


def test_lines_linked_in_turns_are_the_same(docs_of, in_turns, monkeypatch):
    rows = corpus(6)
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "SMALL", 3)  # large groups go to cells
        m.setattr(line_dedup, "CELL", 2)
        got = line_dedup.dedup_report(docs_of(rows)).collect()
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "simhash", lambda x: np.zeros((len(x), 1)))  # all pairs are candidates
        want = brute(rows)
    assert {r.doc_id: (r.n_lines, r.removed, r.kept_in) for r in got} == want


def test_documents_linked_in_turns_are_the_same(docs_of, in_turns):
    rng = random.Random(2)
    rows = []
    for k in range(12):
        text = [f"w{rng.randint(0, 400)}" for _ in range(150)]
        for c in range(5):
            own = list(text)
            own[rng.randrange(150)] = f"c{c}"
            rows.append((10 * k + c, " ".join(own)))
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs_of(rows)).collect()}
    assert got == {d: d - d % 10 for d, _ in rows}
    assert len(in_turns) > 4 and max(x[0] for x in in_turns) > 1
