import random

import numpy as np
import pytest

from cairn.llm import toxicity
from cairn.llm.wordids import to_codes


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(terms, word):
    if word in terms:
        return (word, 0) if terms[word] else None
    best = None
    for t, w in terms.items():
        e = edits(word, t)
        n = len(word)
        most = 0 if n < toxicity.FUZZY_FROM - 1 else 2 if n >= toxicity.FUZZY_2_FROM - 2 else 1
        if w and 0 < e <= most and len(t) >= (0, toxicity.FUZZY_FROM, toxicity.FUZZY_2_FROM)[e]:
            best = min(best or (9,), (e, -w, t))
    return best and (best[2], best[0])


@pytest.mark.parametrize("seed", range(4))
def test_automata_equal_edit_distance(seed):
    rng = random.Random(seed)
    word = lambda a, z: "".join(rng.choice("abc") for _ in range(rng.randint(a, z)))
    terms = {word(3, 15): float(rng.randint(0, 3)) for _ in range(25)}
    lex = toxicity.Lexicon(terms)
    words = [word(1, 16) for _ in range(800)]
    for t in list(terms) * 12:
        w = list(t)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        words.append("".join(w) or "a")
    at = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    near = lex.near(to_codes("".join(words)), at[:-1], at[1:])
    for w, maybe in zip(words, near):
        assert lex.match(w) == brute(terms, w), w
        assert (lex.match(w, int(maybe)) if maybe else None) == brute(terms, w), w


def test_quotation():
    t = 'he wrote "you idiot" and left\nyou idiot "no'
    assert toxicity.quoted(t, 14, 19) and not toxicity.quoted(t, 34, 39)
    assert toxicity.quoted("„du depp“", 4, 8) and toxicity.quoted("a 'depp' b", 3, 7)


def test_marks_of_many_words_at_once():
    t = ['he "said it" now', 'on “a b” c\n" x', '"']
    _, codes, starts, ends, doc, at = toxicity.words_of(t)
    got = toxicity.in_marks(codes, at, starts)
    assert got.tolist() == [False, True, True, False, False, True, True, False, True]


def test_quoted_words_equal_quoted():
    rng = random.Random(5)
    texts = ["", "a", '"a"', "'a'"] + ["".join(rng.choice(['a', 'bc ', ' "', '"', "“", "”", "'", "’", "`", "\n", " "]) for _ in range(rng.randint(1, 30))) for _ in range(800)]
    low, codes, starts, ends, doc, at = toxicity.words_of(texts)
    which = np.array([k for k in range(len(starts)) if k % 3])
    got = toxicity.quoted_words(codes, at, doc, starts, ends, which)
    want = [toxicity.quoted(low[doc[k]], int(starts[k] - at[doc[k]]), int(ends[k] - at[doc[k]])) for k in which]
    assert got.tolist() == want and any(want)


def test_one_very_long_line_of_matches():
    text = "“ idiot " * 150_000
    spans, n = toxicity.Matcher(toxicity.Lexicon({"idiot": 1.0}), frozenset()).spans([text])
    assert len(spans) == n[0] == 150_000 and all(s[3] for s in spans)


def test_learns_terms_misspellings_and_quotation(spark, docs_of):
    rng = random.Random(2)
    fill = lambda: " ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(12))
    rows, labels = [], []
    for k in range(300):
        toxic, quote = k % 3 == 0, k % 3 == 1 and k % 2 == 0
        word = "horriblethug" if k % 2 else "nastyfool"
        text = f"{fill()} {word} {fill()}" if toxic else f'{fill()} they wrote "{word}" {fill()}' if quote else fill()
        rows.append((k, text, 0.5))
        labels.append((k, int(toxic)))
    rows += [(900, "alpha horriblethgu beta", 0.5), (901, "Horribletug", 0.5), (902, None, 0.5), (903, "", 0.5), (903, "", 0.5), (904, "beta " * 5, 0.5), (None, "nastyfool", 0.5)]
    docs = docs_of(rows, "doc_id long, text string, toxicity double")
    sample = docs_of(labels, "doc_id long, y int")
    model = toxicity.fit(docs, sample)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[901].matches[0].term == "horriblethug" and by[901].matches[0].edits == 1
    assert by[900].matches[0].edits == 2
    assert sum((by[k].toxicity >= 0.5) == bool(y) for k, y in labels) >= 0.97 * len(labels)
    assert by[902].toxicity == by[903].toxicity < 0.5 and all(0 <= r.toxicity <= 1 for r in got)
    none = toxicity.score(docs, toxicity.fit(docs, sample.where("false"))).collect()
    assert {r.toxicity for r in none} == {0.5}
    assert toxicity.score(docs.where("false"), model).collect() == []
