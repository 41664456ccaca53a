import random
import re

import numpy as np
import pytest

from cairn.llm import components, ngram_join


def plain_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(d, plain_set(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed, families=8, size=14):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrs")
    shared = [word() for _ in range(60)]
    rows = []
    for f in range(families):
        base = [word() for _ in range(rng.choice([3, 6, 30, 80]))]
        if f % 3 == 0:
            base = shared + base[:12]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w).upper() if rng.random() < 0.2 else rng.choice([" ", "\n", "  "]).join(w))
    rows += ["", None, " \n", "a", "A", "a b", "a  b", "b a", "x y z", "É x y z", "é x y z"]
    rng.shuffle(rows)
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows))


def test_shingles_equal_a_plain_set():
    texts = [t or "" for _, t in corpus(1)]
    h, first = ngram_join.shingles(texts)
    for i, t in enumerate(texts):
        assert first[i + 1] - first[i] == len(plain_set(t))
    k = dict(zip(zip(*(x.tolist() for x in ngram_join.set_keys(h, first))), texts))
    assert len(k) == len({frozenset(plain_set(t)) for t in texts})


@pytest.mark.parametrize("seed,small,cell", [(1, 48, 192), (2, 2, 3), (3, 4, 5), (4, 2, 2)])
def test_components_equal_brute_force(docs_of, monkeypatch, seed, small, cell):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "CELL", cell)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0 if seed == 2 else 1000)
    rows = corpus(seed)
    docs = docs_of([(a, b, 1) for a, b in rows], "doc_id long, text string, n int")
    got = sorted(tuple(r) for r in ngram_join.join(docs).collect())
    assert got == brute(rows)


def test_a_chain_of_near_copies_is_one_component(docs_of):
    w = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(25):
        w[4 * k] = f"v{k}"
        rows.append((k + 7, " ".join(w)))
    got = ngram_join.join(docs_of(rows)).collect()
    assert {r.component_id for r in got} == {7} and sorted(tuple(r) for r in got) == brute(rows)


def test_odd_rows(docs_of):
    long = " ".join(f"w{i}" for i in range(40))
    got = ngram_join.join(docs_of([(None, long), (5, long), (5, long), (9, long.upper()), (3, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [(3, 0, 3), (5, 37, 5), (5, 37, 5), (9, 37, 5)]
    assert ngram_join.join(docs_of([])).collect() == []


@pytest.mark.parametrize("one_task", [0, 20, 1000])
def test_components_of_random_links(docs_of, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(9)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7), (None, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in components.components(docs_of(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
