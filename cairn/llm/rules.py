"""Quality rules by line labelling.

Each line of a text is a position of a linear-chain conditional random field
with the states content and boilerplate; Viterbi decoding labels all lines, and
a document stays if content lines hold at least ``MIN_CONTENT`` of its words.
The field is trained here, on a bounded sample of documents with a quality
label that are not held out: their lines start as content or boilerplate by the
document's label, and one round of self-training lets lines of rejected
documents that look like content become content.

Line features (all counted over whole lines, in numpy): length, words, symbols,
capitals, digits, words equal to the one before, distinct words, words in
repeated 3-word windows, last character, equality with an earlier line.

Words are runs other than U+0020 and U+0009 to U+000D. Null texts have no words
and fail the base rule (fewer than 50 words). Repeated rows are all judged; an
empty table gives no rows. Without labels every line is content. Of other
columns only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import crf
from cairn.llm.common import by_size, texts_of

MAX_DOCS = 3000
MAX_LINES = 48  # of a training document, as WINDOWS runs of lines; decoding takes all lines
WINDOWS = 3
MIN_CONTENT = 0.5
SYMBOLS = "#*$%&|<>"
N_BINS = 12
BATCH = 1 << 20  # bytes of text measured together


class Measure:
    """Counts per document and per line of some whole texts."""

    def __init__(self, texts: list[str]):
        from cairn.llm.quality import kinds
        from cairn.llm.wordids import mix, span_hashes, to_codes

        ln = np.array([len(t) for t in texts], dtype=np.int64)
        at = np.concatenate(([0], np.cumsum(ln)))
        codes = to_codes("".join(texts))
        n, docs = len(codes), len(texts)
        kind = kinds(codes)
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        # lines: every text has at least one
        nl = np.flatnonzero(codes == 10)
        line_from = np.concatenate((at[:-1], nl + 1))
        line_to = np.concatenate((nl, at[1:]))
        doc_of = np.concatenate((np.arange(docs), np.searchsorted(at, nl, side="right") - 1))
        order = np.lexsort((line_from, doc_of))
        self.line_from, self.line_doc = line_from[order], doc_of[order]
        ends_by_doc = np.concatenate((np.searchsorted(at, nl, side="right") - 1, np.arange(docs)))
        self.line_to = line_to[np.lexsort((line_to, ends_by_doc))]
        self.first_line = np.searchsorted(self.line_doc, np.arange(docs + 1))
        # words
        cut = np.ones(n + 1, dtype=bool)
        if n:
            np.not_equal(blank[1:], blank[:-1], out=cut[1:-1])
        cut[at] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], n)[: len(starts)]
        if n:
            keep = ~blank[starts]
            starts, ends = starts[keep], ends[keep]
        h = span_hashes(codes, starts, ends) if n else np.zeros(0, np.uint64)
        doc = np.searchsorted(at, starts, side="right") - 1
        # the line of a word, as the last line that begins at or before it within its document
        line = np.searchsorted(self.line_from, starts, side="right") - 1 if len(starts) else starts
        self.n_words = np.bincount(doc, minlength=docs)
        self.word_chars = np.bincount(doc, weights=ends - starts, minlength=docs).astype(np.int64)
        symbol = np.isin(codes, [ord(c) for c in SYMBOLS])
        self.n_symbols = self._per(symbol, at[:-1], at[1:])
        # words in repeated 3-word windows
        repeat = np.zeros(len(h), dtype=bool)
        if len(h) > 2:
            w3 = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(h[2:] + doc[2:].astype(np.uint64))))
            ok = np.flatnonzero(doc[2:] == doc[:-2])
            _, inv, count = np.unique(w3[ok], return_inverse=True, return_counts=True)
            hit = ok[count[inv] > 1]
            for k in range(3):
                repeat[hit + k] = True
        self.n_repeat = np.bincount(doc[repeat], minlength=docs)
        # lines with a word, equal to an earlier line of the document
        lines = len(self.line_from)
        self.line_words = np.bincount(line, minlength=lines)
        lh = mix(span_hashes(codes, self.line_from, self.line_to) + self.line_doc.astype(np.uint64)) if n else np.zeros(lines, np.uint64)
        worded = np.flatnonzero(self.line_words > 0)
        _, first = np.unique(lh[worded], return_index=True)
        dup = np.zeros(lines, dtype=bool)
        dup[worded] = True
        dup[worded[first]] = False
        self.n_dup = np.bincount(self.line_doc[dup], minlength=docs)
        # line features
        length = np.maximum(self.line_to - self.line_from, 0)
        per = lambda mask: self._per(mask, self.line_from, self.line_to)
        part = lambda a, b: np.ceil(10 * np.minimum(a / np.maximum(b, 1), 1)).astype(np.int64)
        by_line = lambda mask: np.bincount(line[mask], minlength=lines)
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        if len(h):
            _, one = np.unique(mix(h + mix(line.astype(np.uint64))), return_index=True)
        else:
            one = np.zeros(0, np.int64)
        distinct = np.bincount(line[one], minlength=lines)
        letters = per((kind == 1) | (kind == 2))
        tail = np.where(length > 0, kind[np.maximum(self.line_to - 1, 0)] if n else 0, 0)
        stop = np.where(length > 0, np.isin(codes[np.maximum(self.line_to - 1, 0)], [ord(c) for c in ".!?…:;\""]) if n else False, False)
        cols = [np.minimum(np.log2(length + 1), 11).astype(np.int64), np.minimum(np.log2(self.line_words + 1), 11).astype(np.int64),
                part(per(symbol), length / 4), part(per(kind == 2), letters), part(per(kind == 3), length / 2), part(per(codes == 33), length / 8),
                part(by_line(same), self.line_words), part(distinct, self.line_words), part(by_line(repeat), self.line_words),
                tail.astype(np.int64) + 5 * stop.astype(np.int64) * (tail == 4), dup.astype(np.int64), np.zeros(lines, np.int64)]
        self.ids = np.column_stack([c + N_BINS * k for k, c in enumerate(cols)])

    @staticmethod
    def _per(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return c[np.maximum(b, a)] - c[a]


N_FEATURES = 12
N_IDS = N_BINS * N_FEATURES


def line_windows(a: int, z: int) -> list[tuple[int, int]]:
    """Runs of neighbouring lines of [a, z): all of up to ``MAX_LINES``, else
    ``WINDOWS`` runs at the start, the end and evenly between, of ``MAX_LINES`` in all."""
    a, z = int(a), int(z)
    if z - a <= MAX_LINES:
        return [(a, z)]
    size = MAX_LINES // WINDOWS
    return [(x, x + size) for x in (a + (z - a - size) * k // (WINDOWS - 1) for k in range(WINDOWS))]


def _gather_lines(seen: DataFrame) -> list:
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in by_size(whole, limit=BATCH):
                m = Measure(b.column("text").to_pylist())
                ids = [[m.ids[x:z].astype("<u2").tobytes() for x, z in line_windows(m.first_line[d], m.first_line[d + 1])] for d in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(ids, pa.list_(pa.binary()))], names=["y", "ids"])

    return seen.mapInArrow(run, "y int, ids array<binary>").collect()  # at most MAX_DOCS x MAX_LINES lines


def fit(docs: DataFrame, sample: DataFrame):
    """(w, a) of the field; states 0 content, 1 boilerplate. ``sample``: bounded (doc_id, y)."""
    seen = texts_of(docs).join(F.broadcast(sample), "doc_id").select("text", "y")
    # each run of lines is a sequence of its own, so that steps are learned between neighbours only
    rows = sorted((r["y"], bytes(x)) for r in _gather_lines(seen) for x in r["ids"])
    if len({y for y, _ in rows}) < 2:
        w = np.zeros((N_IDS + 1, 2))
        w[:, 0] = 1.0
        return w, np.zeros((2, 2))
    seqs = []
    for y, raw in rows:
        ids = np.frombuffer(raw, "<u2").astype(np.int64).reshape(-1, N_FEATURES)
        seqs.append((ids, np.full(len(ids), int(y == 0))))
    x, y, n = crf.pad(seqs, N_IDS)
    w, a = crf.fit(x, y, n, N_IDS, 2, steps=40)
    # lines of rejected documents that are content by themselves (single-line scores) become content
    e = w[x].sum(axis=2)
    y = np.where((y == 1) & (e[..., 0] > e[..., 1]), 0, y)
    return crf.fit(x, y, n, N_IDS, 2, steps=40)


def judge(docs: DataFrame, model, min_content: float = MIN_CONTENT) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, content_words, boilerplate (numbers of the lines),
    base_failed, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        w, a = shared.value
        for whole in batches:
            for b in by_size(whole, limit=BATCH):
                m = Measure(b.column("text").to_pylist())
                state = crf.viterbi(w[m.ids].sum(axis=1), m.first_line, a)
                content = np.bincount(m.line_doc[state == 0], weights=m.line_words[state == 0], minlength=b.num_rows).astype(np.int64)
                bad = (m.n_words < 50) | (100 * m.n_repeat > 50 * m.n_words)
                kept = ~bad & (content >= min_content * m.n_words)
                lines = [np.flatnonzero(state[m.first_line[d] : m.first_line[d + 1]] == 1) for d in range(b.num_rows)]
                cols = [b.column("doc_id"), b.column("text")] + [pa.array(c.astype(np.int64)) for c in (m.n_words, m.word_chars, m.n_symbols, m.n_dup, m.n_repeat, content)]
                cols += [pa.array(lines, pa.list_(pa.int64())), pa.array(bad), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "boilerplate", "base_failed", "kept"])

    out = "doc_id long, text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, boilerplate array<long>, base_failed boolean, kept boolean"
    return texts_of(docs).mapInArrow(run, out)


def apply(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    from cairn.llm.quality import labelled_sample

    return judge(docs, fit(docs, labelled_sample(labels, "quality", max_docs)))
