import random

from cairn.llm import components
from cairn.llm.common import stored


def reached(links):
    root = {v: v for e in links for v in e}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


def shapes():
    rng = random.Random(4)
    rising = [(k, k + 1) for k in range(5000)]
    return {
        "rising chain": rising,
        "falling chain, both ways, twice": [(b, a) for a, b in rising[:2000]] + rising[:2000],
        "star with a high centre": [(k, 10**12) for k in range(3000)],
        "ladder": [(k, k + 2) for k in range(3000)] + [(2 * k, 2 * k + 1) for k in range(1500)],
        "hubs over rising leaves": [(10**6 + k, k + j) for k in range(1500) for j in range(2)],
        "many at random, negative ids, loops": [(rng.randint(-3000, 3000), rng.randint(-3000, 3000)) for _ in range(2500)] + [(7, 7), (9000, 9000)],
    }


def test_components_in_logarithmic_rounds(spark, docs_of, monkeypatch):
    """All shapes beside each other, as ids of their own."""
    rounds = []

    def counted(df, name, *rest):
        rounds.append(name)
        return stored(df, name, *rest)

    monkeypatch.setattr(components, "ONE_TASK", 0)
    monkeypatch.setattr(components, "stored", counted)
    links = [(a + k * 10**13, b + k * 10**13) for k, links in enumerate(shapes().values()) for a, b in links]
    got = {r.id: r.component for r in components.components(docs_of(links, "a long, b long").repartition(3)).collect()}
    assert got == reached(links)
    assert rounds.count("links") < 20
