import random

import numpy as np

from cairn.llm import quality

ROWS = [(k, ("good plain words here " if k % 2 else "BUY!! NOW!! ") * 5, "x") for k in range(40)] + [(100, None, "x"), (101, "", "x"), (None, "good", "x"), (1, "good plain words here", "x")]


def test_grams_equal_a_plain_count():
    texts = ["The cat the cat", "", "A&&& b", "one"]
    g, d = quality.grams(texts)
    # words + shapes + word pairs + shape pairs + shape triples
    n = [4 * 2 + 3 * 2 + 2, 0, 3 * 2 + 2 * 2 + 1, 2]
    assert [int((d == k).sum()) for k in range(4)] == n
    a, _ = quality.grams(["the cat"])
    b, _ = quality.grams(["THE cat", "the cat"])
    assert set(a) == set(b[_ == 1])


def test_ftrl_learns_and_is_repeatable():
    rng = random.Random(3)
    rows = [(np.array(sorted(rng.sample(range(1, 60), 5)) + ([0] if y else []) + [64]), np.ones(6 + (1 if y else 0))[: 6 + y], y) for y in [0, 1] * 50]
    rows = [(np.unique(i), np.ones(len(np.unique(i))), y) for i, _, y in rows]
    w = quality.ftrl(rows, bits=6)
    assert w[0] > 0 and np.array_equal(w, quality.ftrl(rows, bits=6))
    assert all((w[i] @ x > 0) == bool(y) for i, x, y in rows)


def test_classifies_and_handles_odd_rows(spark, docs_of):
    docs = docs_of(ROWS, "doc_id long, text string, quality_score string")
    labels = docs_of([(k, k % 2, "t") for k in range(40)] + [(None, 1, "t"), (100, None, "t")], "doc_id long, quality int, text string")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r.quality_score for r in got if r.doc_id is not None and r.doc_id < 40}
    assert all((by[k] > 0.5) == bool(k % 2) for k in range(40))
    assert all(0 <= r.quality_score <= 1 for r in got)
    none = quality.classify(docs, labels.where("false")).collect()
    assert {r.quality_score for r in none} == {0.5}
    assert quality.classify(docs.where("false"), labels).collect() == []


def test_sample_is_bounded_and_leaves_out_held_out_rows(docs_of):
    labels = docs_of([(k, 1) for k in range(3000)], "doc_id long, quality int")
    s = quality.labelled_sample(labels, "quality", 500)
    n = s.count()
    assert 350 < n < 650 and s.where(quality.held_out()).count() == 0
