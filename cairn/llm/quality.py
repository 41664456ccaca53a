"""Quality classifier: logistic regression on hashed word n-grams, trained
with follow-the-regularised-leader (FTRL-proximal) updates.

Words are runs of letters and digits, or of other characters. Every word gives
a 1-gram and a 2-gram by its lower-case form and 1- to 3-grams by its shape
(all capitals, capitalised, lower case, digits, or the first symbol; a word
equal to the one before it has a shape of its own). Each n-gram is hashed into
``2**BITS`` weights; a document's value for a feature is its share of the
document's n-grams, so a score is a sparse dot product: the mean weight of the
n-grams found, through the logistic function.

Training takes a bounded sample of the labelled rows (``max_docs``, chosen by
a hash of doc_id) in one task; scoring covers every whole text in parallel with
the weights (fixed size) sent along.

Empty and null texts are scored by the bias alone; label rows with a null label
or doc_id are left out; several labels of one document are several examples;
without any labelled row every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import by_size, new_name, texts_of, tidy

BITS = 20
MAX_DOCS = 8000
EPOCHS = 3
SCALE = 12.0
#: Bytes of text whose n-grams are held at a time.
SLICE = 1 << 20

_KINDS = np.full(0x110000, 255, dtype=np.uint8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 other


def kinds(codes: np.ndarray) -> np.ndarray:
    """Kind of each code point, asked from Python's Unicode tables once each."""
    k = _KINDS[codes]
    new = np.unique(codes[k == 255])
    if len(new):
        for c in new.tolist():
            ch = chr(c)
            _KINDS[c] = 0 if ch.isspace() else 2 if ch.isupper() else 1 if ch.isalpha() else 3 if ch.isnumeric() else 4
        k = _KINDS[codes]
    return k


def grams(texts: list[str], bits: int = BITS):
    """(bucket of every n-gram, document number of each), documents in order."""
    from cairn.llm.wordids import mix, span_hashes, to_codes

    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = to_codes("".join(texts))
    at = np.concatenate(([0], np.cumsum(lengths)))
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds(codes)
    group = np.array([0, 1, 1, 1, 2], dtype=np.uint8)[kind]
    cut = np.ones(len(codes) + 1, dtype=bool)
    np.not_equal(group[1:], group[:-1], out=cut[1:-1])
    cut[at] = True
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], len(codes))
    keep = group[starts] > 0
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(at, starts, side="right") - 1
    low = codes.copy()
    up = np.flatnonzero((kind == 2))
    if len(up):
        u = np.unique(codes[up])
        to = np.array([ord(chr(c).lower()[0]) for c in u.tolist()], dtype=np.uint32)
        low[up] = to[np.searchsorted(u, codes[up])]
    word = span_hashes(low, starts, ends)
    big = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(kind == 2, out=big[1:])
    n_up = big[ends] - big[starts]
    first = kind[starts]
    shape = np.where(first == 4, 100 + codes[starts].astype(np.int64),
                     np.where(first == 3, 3, np.where(n_up == 0, 1, np.where((n_up == ends - starts) & (ends - starts > 1), 4, 2))))
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape = np.where(same, 5, shape).astype(np.uint64)
    shape = mix(shape + np.uint64(0x51ED270B))
    k3, k5, k7 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    sets = [(word, doc), (shape, doc)]
    if len(word) > 1:
        ok = doc[1:] == doc[:-1]
        sets += [(mix(word[:-1] * k3 + word[1:])[ok], doc[1:][ok]), (mix(shape[:-1] * k5 + shape[1:])[ok], doc[1:][ok])]
    if len(word) > 2:
        ok = doc[2:] == doc[:-2]
        sets += [(mix(shape[:-2] * k7 + shape[1:-1] * k5 + shape[2:])[ok], doc[2:][ok])]
    h = np.concatenate([s[0] for s in sets])
    d = np.concatenate([s[1] for s in sets])
    return (h >> np.uint64(64 - bits)).astype(np.int64), d


def ftrl(examples, bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) from (buckets, values, label) rows."""
    n = (1 << bits) + 1
    z, q = np.zeros(n), np.zeros(n)
    if not examples:
        return np.zeros(n, dtype=np.float32)

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(q[i])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)).tolist():
            i, x, y = examples[k]
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(float(w @ x), -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(q[i] + g * g) - np.sqrt(q[i])) / alpha
            z[i] += g - s * w
            q[i] += g * g
    return weight(np.arange(n)).astype(np.float32)


def labelled_sample(labels: DataFrame, label: str, max_docs: int) -> DataFrame:
    """(doc_id, y): about ``max_docs`` labelled rows that are not held out,
    chosen by a hash of doc_id; all of them if there are fewer."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    n = rows.count()
    if n <= max_docs:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(max_docs / n * (1 << 30))))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, sample: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the classifier. ``sample`` (doc_id, y) is bounded, so it may
    be broadcast and its features may meet in one task."""

    def features(batches):
        import pyarrow as pa

        for whole in batches:
            for b in by_size(whole, limit=SLICE):
                g, d = grams(b.column("text").to_pylist(), bits)
                key, count = np.unique(d << bits | g, return_counts=True)
                doc = key >> bits
                cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
                idx, x = [], []
                for a, z in zip(cut[:-1], cut[1:]):
                    idx.append((key[a:z] & ((1 << bits) - 1)).astype("<u4").tobytes())
                    x.append((count[a:z] / max(1, count[a:z].sum()) * SCALE).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(idx, pa.binary()), pa.array(x, pa.binary())], names=["y", "idx", "x"])

    def train(batches):
        import pyarrow as pa

        rows = []
        for b in batches:
            for y, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows.append((np.append(np.frombuffer(i, "<u4").astype(np.int64), 1 << bits), np.append(np.frombuffer(x, "<f4").astype(np.float64), 1.0), y))
        rows.sort(key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))  # the same order on every run
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows, bits, epochs).tobytes()], pa.binary())], names=["w"])

    seen = texts_of(docs).join(F.broadcast(sample), "doc_id").select("text", "y")
    w = seen.mapInArrow(tidy(features), "y int, idx binary, x binary").repartition(1).mapInArrow(train, "w binary").first()
    return np.frombuffer(bytes(w["w"]), "<f4") if w else np.zeros((1 << bits) + 1, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score as ``name``, which must be new."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import pyarrow as pa

        w = shared.value
        for whole in batches:
            for b in by_size(whole, limit=SLICE):
                texts = [t or "" for t in b.column("text").to_pylist()]
                g, d = grams(texts, bits)
                total = np.bincount(d, weights=w[g], minlength=len(texts))
                n = np.bincount(d, minlength=len(texts))
                s = 1 / (1 + np.exp(-np.clip(w[-1] + SCALE * total / np.maximum(n, 1), -35, 35)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(tidy(run), type(docs.schema)([*docs.schema.fields]).add(name, "double"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_docs: int = MAX_DOCS) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``threshold``, all columns kept."""
    name = new_name(docs, "quality_score")
    weights = fit(docs, labelled_sample(labels, "quality", max_docs))
    return score(docs, weights, name=name).where(F.col(name) >= threshold).drop(name)


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, text, quality_score) of every document, by a model fitted on
    the labelled rows that are not held out."""
    weights = fit(docs, labelled_sample(labels, "quality", max_docs))
    return score(texts_of(docs), weights)
