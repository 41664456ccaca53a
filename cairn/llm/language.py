"""Language identification: nearest centroid over TF-IDF character n-grams.

Texts are lower-cased; everything between words is one gap, and so are words that hold a digit (keys,
numbers). A word is a run of letters, combining marks and digits.
Every letter gives four n-grams (itself, with the one before, with both
neighbours, and with the two before and the one after), hashed into ``2**BITS``
buckets. A vector's values are (1 + log count) * idf, scaled to length one.
Each language has up to ``CENTROIDS`` centroids, found by spherical k-means of its
sampled texts; a text gets the language of the centroid with the largest
cosine. It is *rejected* if its cosine distance exceeds that centroid's
radius, the largest distance of nearly all (``WITHIN``) of its own texts, widened by ``SLACK``.

Document frequencies are counted over all learnable texts; the centroids are
fitted on about ``MAX_DOCS`` distinct texts of each language, chosen by a hash of the text. Scoring covers whole texts in parallel, with the centroids
(languages x ``CENTROIDS`` x 2**BITS x 4 bytes, 0.5 MB a language) sent along; a table with more
than ``MAX_LANGUAGES`` languages raises an error rather than send more.

A text that is null or has no letter is ``und`` with score 0, distance 1 and rejected;
so is every text if nothing can be learned. The score is the cosine, at least 0; ties go to the
smaller language value. Rows with a null lang or text teach nothing. A text whose letters
all stand beside digits has distance 1 to every centroid. A word of over 2^20 letters is cut. Repeated rows are rows of their own, an empty
table gives no rows, columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import by_size

BITS = 15
CENTROIDS = 4
MAX_DOCS = 600
MAX_LANGUAGES = 256
WITHIN, SLACK = 0.99, 1.1
UNKNOWN = "und"
PIECE = 1 << 20

#: Lower-case code point of a letter or mark, DIGIT of digits, 0 of others, UNSEEN until asked; and which are letters.
UNSEEN, DIGIT = 0xFFFFFFFF, 0xFFFFFFFE
_LOW = np.full(0x110000, UNSEEN, dtype=np.uint32)
_LETTER = np.zeros(0x110000, dtype=bool)


def lowered(codes: np.ndarray) -> np.ndarray:
    low = _LOW[codes]
    new = np.unique(codes[low == UNSEEN])
    if len(new):
        for c in new.tolist():
            kind = unicodedata.category(chr(c))[0]
            _LETTER[c] = kind == "L"
            _LOW[c] = ord(chr(c).lower()[0]) if kind in "LM" else DIGIT if kind == "N" else 0
        low = _LOW[codes]
    return low


def _buckets(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4 x letters) buckets of ``codes``, the place of each letter or mark, and which places of ``codes`` are letters."""
    from cairn.llm.wordids import mix

    low = lowered(codes)
    digit = low == DIGIT
    if digit.any():
        inside = low > 0
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        word = np.cumsum(starts)
        low[inside & (np.bincount(word, weights=digit, minlength=int(word[-1]) + 1)[word] > 0)] = 0
    gap = low == 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # of a gap its first place only
    at = np.flatnonzero(keep)
    c = np.concatenate(([0, 0], low[at], [0])).astype(np.uint64) + np.uint64(1)
    i = np.flatnonzero(c[2:-1] > 1) + 2
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    here, back, next_ = c[i] * k1, c[i - 1] * k2, c[i + 1] * k3
    # what lies before a gap is no neighbour
    back2 = np.where(c[i - 1] > 1, c[i - 2], np.uint64(1))
    two = here + back
    three = two + next_
    four = three + back2 * (k1 ^ k2)
    grams = np.stack([here, two + np.uint64(0x1001), three + np.uint64(0x2002), four + np.uint64(0x3003)])
    place = at[i - 2]
    return (mix(grams) >> np.uint64(64 - bits)).astype(np.int32), place, _LETTER[codes]


def counts(texts: list[str | None], bits: int = BITS):
    """For each text: its count per bucket (an array of 2**bits), or None without a letter."""
    from cairn.llm.wordids import to_codes

    size = 1 << bits
    small = [t or "" for t in texts]
    if len(small) == 1 and len(small[0]) > PIECE:
        codes = to_codes(small[0])
        total, letter, at = np.zeros(size, dtype=np.int64), False, 0
        while at < len(codes):
            to = at + PIECE
            if to < len(codes):  # cut at the last gap of the piece, so that no n-gram is lost
                gaps = np.flatnonzero(lowered(codes[at:to]) == 0)
                to = at + int(gaps[-1]) + 1 if len(gaps) else to
            b, _, is_letter = _buckets(codes[at:to], bits)
            total += np.bincount(b.ravel(), minlength=size)
            letter |= bool(is_letter.any())
            at = to
        yield total if letter else None
        return
    lengths = np.array([len(t) + 1 for t in small], dtype=np.int64)
    b, place, is_letter = _buckets(to_codes("\n".join(small) + "\n"), bits)
    cut = np.searchsorted(place, np.concatenate(([0], np.cumsum(lengths))))
    ends = np.cumsum(lengths)
    letters = np.add.reduceat(is_letter.astype(np.int64), ends - lengths)
    for a, z, n in zip(cut[:-1].tolist(), cut[1:].tolist(), letters.tolist()):
        yield np.bincount(b[:, a:z].ravel(), minlength=size) if n else None


def unit(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of the normalised TF-IDF vector."""
    i = np.flatnonzero(count)
    x = (1 + np.log(count[i])) * idf[i]
    n = np.sqrt(x @ x)
    return i, (x / n if n else x).astype(np.float32)


def learnable(docs: DataFrame, use: Column) -> DataFrame:
    return docs.where(use).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")


def idf_of(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """Inverse document frequency of every bucket, over all of ``rows`` (text)."""
    size = 1 << bits

    def run(batches):
        import pyarrow as pa

        df = np.zeros(size + 1, dtype=np.int64)
        for whole in batches:
            for b in by_size(whole, limit=PIECE):
                for c in counts(b.column("text").to_pylist(), bits):
                    if c is not None:
                        df[:size] += c > 0
                        df[size] += 1
        i = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(df[i])], names=["bucket", "n"])

    sums = rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most 2**bits + 1 rows
    df = np.zeros(size + 1)
    for r in sums:
        df[r["bucket"]] = r["n"]
    return np.log((1 + df[size]) / (1 + df[:size])) + 1


def sampled(rows: DataFrame, max_docs: int) -> DataFrame:
    """Of each language about ``max_docs`` distinct texts, by their hashes; all of them if there are fewer."""
    h, parts = F.xxhash64("text"), 1 << 30
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages to learn")
    if not sizes:
        return rows.where(F.lit(False))
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(max_docs / max(1, r["n"]) * parts)))]), F.col("lang"))
    return rows.withColumn("h", h).where(F.pmod(F.col("h"), F.lit(parts)) < share).dropDuplicates(["lang", "h"]).select("lang", "text")


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows: unit centroids and each row's number. Starts far apart."""
    mean = x.mean(axis=0)
    best = x @ mean
    c = [x[int(best.argmax())]]
    near = x @ c[0]
    while len(c) < min(k, len(x)):
        c.append(x[int(near.argmin())])
        near = np.maximum(near, x @ c[-1])
    c = np.array(c)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                n = np.sqrt(m @ m)
                c[j] = m / n if n else m
    return c, (x @ c.T).argmax(axis=1)


class Model:
    """idf, unit centroids (2**bits x centroids), their languages and radii."""

    def __init__(self, idf, centroids, langs, radii):
        self.idf, self.centroids, self.langs, self.radii = idf, centroids, langs, radii


def fit(rows: DataFrame, bits: int = BITS, k: int = CENTROIDS, max_docs: int = MAX_DOCS) -> Model:
    """The model of ``rows`` (lang, text)."""
    size, idf = 1 << bits, idf_of(rows, bits)

    def vectors(batches):
        import pyarrow as pa

        for whole in batches:
            for b in by_size(whole, limit=PIECE):
                out = [(lang, *unit(c, idf)) for lang, c in zip(b.column("lang").to_pylist(), counts(b.column("text").to_pylist(), bits)) if c is not None]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1].astype("<i4").tobytes() for o in out], pa.binary()), pa.array([o[2].astype("<f4").tobytes() for o in out], pa.binary())], names=["lang", "idx", "x"])

    def train(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["idx", "x"])  # the same order on every run
        x = np.zeros((len(pdf), size), dtype=np.float32)
        for row, i, v in zip(x, pdf["idx"], pdf["x"]):
            row[np.frombuffer(i, "<i4")] = np.frombuffer(v, "<f4")
        c, own = clustered(x, k)
        far = 1 - np.einsum("ij,ij->i", x, c[own])
        used = [j for j in range(len(c)) if (own == j).any()]
        radius = [min(1.0, float(np.quantile(far[own == j], WITHIN)) * SLACK) for j in used]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(used), "centroid": [c[j].astype("<f4").tobytes() for j in used], "radius": radius})

    groups = sampled(rows, max_docs).mapInArrow(vectors, "lang string, idx binary, x binary").groupBy("lang")  # about max_docs rows each
    # at most MAX_LANGUAGES * k rows
    found = sorted(groups.applyInPandas(train, "lang string, centroid binary, radius double").collect(), key=lambda r: (r["lang"], r["radius"], bytes(r["centroid"])))
    c = np.array([np.frombuffer(bytes(r["centroid"]), "<f4") for r in found], dtype=np.float32).reshape(-1, size).T
    return Model(idf, np.ascontiguousarray(c), [r["lang"] for r in found], np.array([r["radius"] for r in found]))


RESULT = "doc_id long, lang_pred string, score double, distance double, rejected boolean"


def predict(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """doc_id, lang_pred (of the nearest centroid, or ``und``), score, distance, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for whole in batches:
            for b in by_size(whole, limit=PIECE):
                lang, score, rejected = [], [], []
                for c in counts(b.column("text").to_pylist(), bits):
                    if c is None or not m.langs:
                        lang.append(UNKNOWN), score.append(0.0), rejected.append(True)
                        continue
                    i, x = unit(c, m.idf)
                    near = x @ m.centroids[i]
                    j = int(near.argmax())
                    s = min(1.0, max(0.0, float(near[j])))
                    lang.append(m.langs[j]), score.append(s), rejected.append(1 - s > m.radii[j])
                s = np.array(score, dtype=np.float64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(s), pa.array(1 - s), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "distance", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def identify(docs: DataFrame, use: Column | None = None, **kw) -> DataFrame:
    """``predict`` for all of ``docs`` (doc_id, text, lang) with a model of those for
    which ``use`` holds; by default those not held out by crc32 of doc_id."""
    from cairn.llm.quality import held_out

    use = F.coalesce(~held_out(), F.lit(False)) if use is None else use
    return predict(docs, fit(learnable(docs, use), **kw), kw.get("bits", BITS))

