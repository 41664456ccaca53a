import itertools
import random
import re

import numpy as np
import pytest

from cairn.llm import crf, rules


def best_path(e, a):
    return max(itertools.product(range(e.shape[1]), repeat=len(e)), key=lambda y: sum(e[i, s] for i, s in enumerate(y)) + sum(a[x, z] for x, z in zip(y[:-1], y[1:])))


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    ln = [1, 5, 0, 3, 6, 1]
    first = np.concatenate(([0], np.cumsum(ln)))
    e, a = rng.normal(size=(first[-1], 3)), rng.normal(size=(3, 3))
    begin, end = rng.normal(size=(6, 3)), rng.normal(size=(6, 3))
    got = crf.viterbi(e, first, a)
    both = crf.viterbi(e, first, a, begin, end)
    for i, n in enumerate(ln):
        part = e[first[i] : first[i + 1]]
        if n:
            assert tuple(got[first[i] : first[i + 1]]) == best_path(part, a)
            part = part.copy()
            part[0] += begin[i]
            part[-1] += end[i]
            assert tuple(both[first[i] : first[i + 1]]) == best_path(part, a)


def test_posteriors_equal_all_paths():
    rng = np.random.default_rng(2)
    e, a = rng.normal(size=(2, 4, 2)), rng.normal(size=(2, 2))
    n = np.array([4, 2])
    z, states, step = crf.posteriors(e, a, n)
    for b in range(2):
        paths = list(itertools.product(range(2), repeat=int(n[b])))
        s = np.array([np.exp(sum(e[b, i, y] for i, y in enumerate(p)) + sum(a[x, y] for x, y in zip(p[:-1], p[1:]))) for p in paths])
        assert np.isclose(z[b], np.log(s.sum()))
        for i in range(n[b]):
            assert np.isclose(states[b, i, 1], s[[p[i] == 1 for p in paths]].sum() / s.sum())
        assert np.isclose(step[b, 0, 0, 1], s[[p[:2] == (0, 1) for p in paths]].sum() / s.sum())


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    wins = {}
    for i in range(len(words) - 2):
        wins.setdefault(tuple(words[i : i + 3]), []).append(i)
    rep = {i + k for v in wins.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)


@pytest.mark.parametrize("seed", range(5))
def test_counts_equal_a_plain_count(seed):
    rng = random.Random(seed)
    texts = ["", "\n", " \n\n a", "a b c a b c", "x\nx\nx\n y\ny", "é\x0b|#\x85 z w\n"] + ["".join(rng.choice(["a ", "b ", "\n", "ab", " ", "|", "\t"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    m = rules.Measure(texts)
    for k, t in enumerate(texts):
        assert (m.n_words[k], m.word_chars[k], m.n_symbols[k], m.n_dup[k], m.n_repeat[k]) == plain(t), repr(t)
        assert m.first_line[k + 1] - m.first_line[k] == t.count("\n") + 1
        assert m.line_words[m.first_line[k] : m.first_line[k + 1]].tolist() == [len(re.findall("[^\x20\x09-\x0d]+", x)) for x in t.split("\n")]


def test_marks_boilerplate_and_keeps_clean(spark, docs_of):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    good = lambda n: "\n".join(" ".join(word() for _ in range(20)).capitalize() + "." for _ in range(n))
    bad = lambda n: "\n".join(" | ".join(word() for _ in range(15)) for _ in range(n))
    rows = [(k, good(5) if k % 2 else good(1) + "\n" + bad(6), "t") for k in range(80)]
    rows += [(100, good(6) + "\n" + bad(1), "t"), (101, bad(6), "t"), (102, None, "t"), (103, "", "t"), (None, good(4), "t"), (1, rows[1][1], "t")]
    docs = docs_of(rows, "doc_id long, text string, kept string")
    labels = docs_of([(k, k % 2) for k in range(80)] + [(101, None)], "doc_id long, quality int")
    got = rules.apply(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].kept == bool(k % 2) for k in range(80))
    assert by[100].kept and by[100].boilerplate == [6] and not by[101].kept and by[None].kept
    assert by[102].base_failed and by[103].base_failed and by[102].n_words == 0 and not by[103].kept
    assert all(r.kept for r in rules.apply(docs, labels.where("false")).collect() if not r.base_failed)
    assert rules.apply(docs.where("false"), labels).collect() == []


def test_training_lines_are_neighbours():
    for a, z in ((0, 1), (5, 5 + rules.MAX_LINES), (3, 4 + rules.MAX_LINES), (0, 1000), (7, 100_000)):
        runs = rules.line_windows(a, z)
        lines = [i for x, y in runs for i in range(x, y)]
        assert len(lines) == min(z - a, rules.MAX_LINES) and lines[0] == a and lines[-1] == z - 1
        if z - a >= 2 * rules.MAX_LINES:
            assert len(runs) == rules.WINDOWS and len(set(lines)) == len(lines)


def test_steps_are_learned_between_neighbours(spark, docs_of):
    """A long document whose lines alternate: no line stands beside its like."""
    docs = docs_of([(1, "\n".join(["some words of text here." if k % 2 == 0 else "| | |" for k in range(2001)]))])
    seen = docs.selectExpr("text", "1 as y")
    runs = [np.frombuffer(bytes(x), "<u2").reshape(-1, rules.N_FEATURES) for r in rules._gather_lines(seen) for x in r["ids"]]
    assert len(runs) == rules.WINDOWS and all((x[1:, 0] != x[:-1, 0]).all() for x in runs)
