import numpy as np
from pyspark.sql import functions as F

from cairn.llm import language as L
from cairn.llm.common import read
from cairn.llm.queries import op12_language_centroids

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"aa": "the of and ing that with tion".split(), "bb": "der und ung sch ein keit zu".split(), "cc": "que ción los las ñor está y".split()}


def rows_of(n=60, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang], 30)).capitalize() + ".", lang) for i, lang in ((i, ("aa", "bb", "cc")[i % 3]) for i in range(n))]


def plain_counts(text, bits=L.BITS):
    """Count of every 4-gram kind's (length, letters) written out, as a check of how many n-grams there are."""
    words = "".join(c.lower() if c.isalpha() else "0" if c.isnumeric() else " " for c in text).split()
    return sum(4 * len(w) for w in words if "0" not in w)


def test_counts_are_the_same_in_any_company():
    texts = ["Hello, wörld!", None, "", "123 !!", "x9y only digits", "ΑΒΓ αβγ", "日本語 text", "a" * 50, "Hello, wörld!"]
    alone = [next(iter(L.counts([t]))) for t in texts]
    together = list(L.counts(texts))
    for t, a, b in zip(texts, alone, together):
        assert (a is None) == (b is None) == (not t or not any(c.isalpha() for c in t))
        assert a is None or ((a == b).all() and a.sum() == plain_counts(t))
    assert (together[0] == next(iter(L.counts(["HELLO   -- WÖRLD"])))).all()


def test_pieces_of_a_long_text_add_up(monkeypatch):
    text = " ".join(f"{w}{'' if i % 7 else i}" for i, w in enumerate(WORDS["bb"] * 400))
    whole = next(iter(L.counts([text])))
    monkeypatch.setattr(L, "PIECE", 100)
    assert (next(iter(L.counts([text]))) == whole).all() and whole.sum() == plain_counts(text)


def brute(train, texts, bits=12, k=2):
    """Nearest centroid with dense vectors, given the fitted centroids' rule only."""
    df = sum((np.array([next(iter(L.counts([t], bits)))]) > 0).sum(axis=0) for t, _ in train)
    idf = np.log((1 + len(train)) / (1 + df)) + 1

    def vector(t):
        c = next(iter(L.counts([t], bits)))
        x = np.where(c > 0, (1 + np.log(np.maximum(c, 1))) * idf, 0)
        return x / np.linalg.norm(x)

    return idf, vector


def test_vectors_are_tf_idf_over_all_learnable_texts(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    idf, vector = brute([(t, lang) for _, t, lang in rows], None)
    got = L.idf_of(df, 12)
    assert np.allclose(got, idf)
    i, x = L.unit(next(iter(L.counts([rows[0][1]], 12))), got)
    dense = np.zeros(1 << 12)
    dense[i] = x
    assert np.allclose(dense, vector(rows[0][1]), atol=1e-6)


def test_prediction_is_the_nearest_centroid(spark):
    df = spark.createDataFrame(rows_of(90), SCHEMA)
    model = L.fit(L.learnable(df, F.col("doc_id") < 60), bits=12, k=3)
    assert set(model.langs) == {"aa", "bb", "cc"} and len(model.langs) > 3  # several centroids a language
    assert np.allclose((model.centroids**2).sum(axis=0), 1, atol=1e-5)
    _, vector = brute([(t, lang) for i, t, lang in rows_of(90) if i < 60], None)
    for r in L.predict(df, model, 12).join(df, "doc_id").collect():
        near = vector(r["text"]) @ model.centroids
        assert r["lang_pred"] == model.langs[int(near.argmax())] == r["lang"] and abs(r["score"] - near.max()) < 1e-5
        assert r["rejected"] == (1 - r["score"] > model.radii[int(near.argmax())]) and abs(r["distance"] + r["score"] - 1) < 1e-9


def test_odd_rows(spark):
    rows = rows_of()
    odd = [(None, rows[0][1], "aa"), (900, None, "aa"), (901, "", "bb"), (902, "12 ...", None), (903, "a1 b2", "aa"), (904, "qzx jkvw " * 20, None), (905, rows[1][1], None), (905, rows[1][1], None),
           (906, (rows[2][1] + " ") * 8000, None), (907, "x" * (L.PIECE + 10), None)]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("doc_id", "text", "lang", "1 as score", "2 as lang_pred", "3 as h")
    got = L.identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got if r["doc_id"] and r["doc_id"] >= 900}
    for i in (900, 901, 902):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["distance"], by[i]["rejected"]) == ("und", 0.0, 1.0, True)
    assert by[903]["lang_pred"] in WORDS and by[903]["score"] == 0 and by[903]["rejected"]
    assert by[904]["lang_pred"] in WORDS and by[904]["rejected"] and by[907]["lang_pred"] in WORDS
    assert by[905]["lang_pred"] == "bb" and by[906]["lang_pred"] == "cc" and not by[905]["rejected"]


def test_nothing_to_learn_and_nothing_to_do(spark):
    df = spark.createDataFrame([(1, "words", None), (2, None, "aa")], SCHEMA)
    assert [(r["lang_pred"], r["score"]) for r in L.identify(df).collect()] == [("und", 0.0)] * 2
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = op12_language_centroids(spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == read(spark, sf, "documents").count()
    held = out.where("held_out").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in held)
