"""Secret scans: base patterns, and a linear-chain conditional random field
that tags tokens as begin, inside or outside of a secret.

Tokens are runs of word characters or of other characters that aren't white
space. Features: a token's shape (length, kinds of characters, hexadecimal or
not), how often letters and digits alternate in it, its own and its neighbours'
words (hashed), and the file's share of digits. The field is trained here on a
bounded sample of documents: tokens inside base spans are B and I, all others
O; windows with long tokens of letters and digits outside of base spans don't
train, as these may be secrets; for half of the windows the neighbours' words
are hidden, so that shape counts too. Decoding is Viterbi over whole texts. Tokens whose score for
O is ahead by more than any two transitions can bring are O on every best path,
so only the stretches between them need the lattice.

Base spans always stay; spans of the field that overlap no base span are added
with the kind ``crf``. Offsets are code points, ends exclusive. Null and empty
texts have no spans; repeated rows are all scanned; an empty table gives no
rows; without any base span in the table the field adds none. ``redact``
replaces the spans in the text and keeps all other columns.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import crf
from cairn.llm.common import by_size, new_name, stored, texts_of, tidy, with_n_chars

# Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")

MAX_DOCS = 4000
SECRETS = 4  # of a training document
WINDOW = 12
WORDS = 1 << 11
BATCH = 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # runs shorter than 16 are dropped, so only longer ones need be found
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def value_spans(text: str, spans) -> list[tuple[int, int]]:
    """The secret itself: the value of an assignment, a whole other span."""
    return [ASSIGN.match(text, a).span(2) if kind == 0 else (a, b) for a, b, kind in spans]


_SHAPES = 256
_N = _SHAPES + 6 + 5 * WORDS + 8 + 8
OFF = np.cumsum([0, _SHAPES, 6, WORDS, WORDS, WORDS, WORDS, WORDS, 8])  # shape, alternation, own, 3 before, 1 after, file


class Tokens:
    """Spans and feature ids of the tokens of some whole texts."""

    def __init__(self, texts: list[str]):
        from cairn.llm.quality import kinds
        from cairn.llm.wordids import span_hashes, to_codes

        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        codes = to_codes("".join(texts))
        n = len(codes)
        kind = kinds(codes)
        group = np.array([0, 1, 1, 1, 2], dtype=np.uint8)[kind]
        group[codes == 95] = 1
        cut = np.ones(n + 1, dtype=bool)
        if n:
            np.not_equal(group[1:], group[:-1], out=cut[1:-1])
        cut[at] = True
        s = np.flatnonzero(cut[:-1])
        e = np.append(s[1:], n)[: len(s)]
        if n:
            keep = group[s] > 0
            s, e = s[keep], e[keep]
        self.doc = np.searchsorted(at, s, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.start, self.end = s - at[self.doc], e - at[self.doc]
        self.odd = np.zeros(len(s), dtype=bool)
        if not len(s):
            self.ids = np.zeros((0, len(OFF)), dtype=np.int64)
            return

        def per(mask):
            c = np.concatenate(([0], np.cumsum(mask)))
            return c[e] - c[s]

        low = codes | np.where((codes >= 65) & (codes <= 90), 32, 0).astype(np.uint32)
        size = e - s
        digits, lower, upper = per(kind == 3), per(kind == 1), per(kind == 2)
        #: long tokens of letters and digits: not known to be harmless where no base pattern holds
        self.odd = (size >= 16) & (digits > 0) & (lower + upper > 0)
        hexa = per(((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 102)))
        bucket = np.searchsorted([3, 5, 8, 12, 16, 24, 40], size, side="right")
        shape = bucket * 16 + (lower > 0) + 2 * (upper > 0) + 4 * (digits > 0) + 8 * (hexa == size)
        other = group[s] == 2
        shape = np.where(other, 128 + (codes[s] % 64).astype(np.int64) + 64 * (size > 1), shape)
        flip = np.zeros(n, dtype=bool)
        flip[1:] = (kind[1:] == 3) != (kind[:-1] == 3)
        flip[s] = False
        alter = np.minimum(5, np.ceil(8 * per(flip) / np.maximum(size, 1))).astype(np.int64)
        word = np.where(size <= 16, (span_hashes(low, s, e) % np.uint64(WORDS - 1)).astype(np.int64) + 1, 0)

        def beside(k):
            out = np.zeros(len(s), dtype=np.int64)
            if k < 0:
                out[-k:] = np.where(self.doc[-k:] == self.doc[:k], word[:k], 0)
            else:
                out[:-k] = np.where(self.doc[:-k] == self.doc[k:], word[k:], 0)
            return out

        share = np.concatenate(([0], np.cumsum(kind == 3)))
        per_doc = np.minimum(7, 40 * (share[at[1:]] - share[at[:-1]]) / np.maximum(at[1:] - at[:-1], 1)).astype(np.int64)
        cols = (shape, alter, word, beside(-1), beside(-2), beside(-3), beside(1), per_doc[self.doc], np.zeros(len(s), np.int64))
        self.ids = np.column_stack([c + o for c, o in zip(cols, OFF)])


NEIGHBOURS = slice(3, 7)


def _windows(texts: list[str], rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training windows: around each secret, and one elsewhere in each document."""
    t, out = Tokens(texts), []
    for d, text in enumerate(texts):
        a, z = int(t.first[d]), int(t.first[d + 1])
        if a == z:
            continue
        y = np.zeros(z - a, dtype=np.int64)
        at = []
        for x, b in value_spans(text, base_spans(text)):
            k = np.flatnonzero((t.start[a:z] < b) & (t.end[a:z] > x))
            if len(k):
                y[k] = 2
                y[k[0]] = 1
                at.append(int(k[0]))
        # of more than SECRETS secrets, some are drawn over the whole text
        some = at if len(at) <= SECRETS else [at[k] for k in sorted(rng.choice(len(at), SECRETS, replace=False))]
        for k in some + [int(rng.integers(0, z - a))]:
            lo, hi = max(0, k - WINDOW), min(z - a, k + WINDOW)
            if not (t.odd[a + lo : a + hi] & (y[lo:hi] == 0)).any():
                out.append((t.ids[a + lo : a + hi].copy(), y[lo:hi]))
    return out


#: Matches every text with a base span, and few others.
MAYBE = r"""AKIA[A-Z0-9]{14}|[0-9a-f]{16}|(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12})"""


def _holds(batches):
    """The hashes of texts with a base span."""
    import pyarrow as pa

    for whole in batches:
        for b in by_size(whole, limit=BATCH):
            kept = [k for k, x in zip(b.column("near").to_pylist(), b.column("text").to_pylist()) if base_spans(x)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["near"])


def fit(docs: DataFrame, max_docs: int = MAX_DOCS):
    """(w, a) of the field from at most about ``max_docs`` documents, half of
    them with a base span (found by a scan of all rows), chosen by a hash; None
    if there is no base span."""
    t = texts_of(docs)

    def windows(batches):
        import pyarrow as pa

        for whole in batches:
            for b in by_size(whole, limit=BATCH):
                has, xs, ys = [], [], []
                for x, seed in zip(b.column("text").to_pylist(), b.column("near").to_pylist()):
                    found = _windows([x], np.random.default_rng(seed))
                    has.append(any(y.any() for _, y in found))
                    xs.append([a.astype("<u2").tobytes() for a, _ in found])
                    ys.append([y.astype("<u1").tobytes() for _, y in found])
                yield pa.RecordBatch.from_arrays([b.column("near"), pa.array(has), pa.array(xs, pa.list_(pa.binary())), pa.array(ys, pa.list_(pa.binary()))], names=["near", "has", "x", "y"])

    near = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    t = t.select(near.alias("near"), "text")
    # the secrets may be anywhere, so all rows are scanned for them before a hash draws some
    maybe = F.col("text").rlike(MAYBE)
    held = stored(t.where(maybe).mapInArrow(tidy(_holds), "near long"), "held")
    last = held.orderBy("near").limit(2 * max_docs).agg(F.max("near")).first()[0]
    if last is None:
        return None
    # a hash picks the same documents on every run; the share comes from the number of rows
    other = int(min(1.0, 8 * max_docs / max(t.count(), 1)) * (1 << 30))
    some = t.where((F.col("near") < other) | ((F.col("near") <= last) & maybe))
    seen = stored(some.mapInArrow(tidy(windows), "near long, has boolean, x array<binary>, y array<binary>"), "windows")
    take = seen.where("has").orderBy("near").limit(max_docs // 2).unionByName(seen.where("not has").orderBy("near").limit(max_docs // 2))
    # at most 5 windows of 2 x WINDOW tokens for each of max_docs documents
    rows = sorted((bytes(x), bytes(y)) for r in take.select("x", "y").collect() for x, y in zip(r["x"], r["y"]))
    seqs, rng = [], np.random.default_rng(5)
    for x, y in rows:
        ids, y = np.frombuffer(x, "<u2").astype(np.int64).reshape(-1, len(OFF)), np.frombuffer(y, "<u1").astype(np.int64)
        ids = ids.copy()
        if rng.random() < 0.5:
            ids[:, NEIGHBOURS] = _N
        seqs.append((ids, y))
    if not any((y > 0).any() for _, y in seqs):
        return None
    x, y, ln = crf.pad(seqs, _N)
    return crf.fit(x, y, ln, _N, 3, steps=40)


def decode(t: Tokens, model) -> np.ndarray:
    """Best tags of all tokens (0 outside, 1 begin, 2 inside)."""
    w, a = model
    tags = np.zeros(len(t.start), dtype=np.int8)
    if not len(tags):
        return tags
    e = np.zeros((len(tags), 3))
    for k in range(t.ids.shape[1]):
        e += w[t.ids[:, k]]
    sure = e[:, 0] - e[:, 1:].max(axis=1) > 2 * (a.max() - a.min())
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return tags
    new = np.ones(len(open_), dtype=bool)
    new[1:] = (open_[1:] != open_[:-1] + 1) | (t.doc[open_[1:]] != t.doc[open_[:-1]])
    first = np.flatnonzero(new)
    head, tail = open_[first], open_[np.append(first[1:], len(open_)) - 1]
    starts_doc = np.isin(head, t.first)
    ends_doc = np.isin(tail + 1, t.first)
    tags[open_] = crf.viterbi(e[open_], np.append(first, len(open_)), a, np.where(starts_doc[:, None], 0, a[0]), np.where(ends_doc[:, None], 0, a[:, 0]))
    return tags


def tagged_spans(t: Tokens, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, end) of every B, or I without a span before it, and the I that follow."""
    out: list[list[int]] = []
    last = -2
    for k in np.flatnonzero(tags).tolist():
        if tags[k] == 2 and out and last == k - 1 and t.doc[k] == out[-1][0]:
            out[-1][2] = int(t.end[k])
        else:
            out.append([int(t.doc[k]), int(t.start[k]), int(t.end[k])])
        last = k
    return [tuple(s) for s in out]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def apart(added: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of the spans ``added``, by start and apart from each other, those that
    overlap none of ``base`` (by start; these may overlap each other)."""
    out, k, reach = [], 0, 0
    for a, b in added:
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def _find(texts: list[str], model) -> list[list[dict]]:
    found = [base_spans(x) for x in texts]
    if model is not None:
        t = Tokens(texts)
        added = tagged_spans(t, decode(t, model))
        for d, spans in itertools.groupby(added, key=lambda s: s[0]):
            found[d] += [(a, b, 3) for a, b in apart([s[1:] for s in spans], found[d])]
    return [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted(s, key=lambda s: (s[0], s[2]))] for s in found]


def scan(docs: DataFrame, model, name: str = "secret_spans") -> DataFrame:
    """All columns of ``docs`` and, as ``name`` (which must be new), kind, start, end, by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for b in by_size(whole, limit=BATCH):
                spans = _find([x or "" for x in b.column("text").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*b.schema.names, name])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields]).add(name, T._parse_datatype_string(SPANS)))


def joined(spans, base_only: bool):
    """kind:start:end of the spans, joined by commas."""
    s = F.filter(spans, lambda x: x["kind"] != "crf") if base_only else spans
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(scanned: DataFrame, mark: str = "[secret]", name: str = "secret_spans") -> DataFrame:
    """``text`` with every span of column ``name`` replaced and that column
    dropped; overlapping spans are replaced together."""

    def run(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for x, s in zip(text, spans):
            if x is None or s is None or not len(s):
                out.append(x)
                continue
            parts, at = [], 0
            for p in sorted(s, key=lambda p: (p["start"], p["end"])):
                if p["start"] >= at:
                    parts += [x[at : p["start"]], mark]
                at = max(at, p["end"])
            out.append("".join(parts) + x[at:])
        return pd.Series(out, dtype=object)

    text = F.when(F.size(name) > 0, F.pandas_udf(run, "string")("text", name)).otherwise(F.col("text"))
    return with_n_chars(scanned.withColumn("text", text), F.size(name) > 0).drop(name)


def without_secrets(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` with its secrets replaced, all columns kept."""
    name = new_name(docs, "secret_spans")
    return redact(scan(docs, fit(docs, max_docs), name), name=name)


def find(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, text, secret_spans) of every document, with a field fitted on a bounded sample."""
    t = texts_of(docs)
    return scan(t, fit(t, max_docs))
