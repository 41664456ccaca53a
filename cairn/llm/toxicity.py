"""Toxicity: a lexicon learned from labels, matched through Levenshtein
automata, and scored with the context of each match.

* ``learn_lexicon``: words that labelled toxic documents hold far more often
  than others (document frequencies, counted in Spark over a bounded sample of
  labelled rows).
* ``Lexicon.match``: the Levenshtein automaton of a text's word (bit-parallel,
  one bit mask per number of edits) is run along the lexicon's trie; a branch
  is left as soon as no state is alive. Words that can be no match are sorted
  out before, in numpy (``Lexicon.near``; it loses none). Terms of ``FUZZY_FROM`` letters and more
  may differ by one edit, of ``FUZZY_2_FROM`` and more by two. Each distinct
  word is matched once per task.
* Context: a match inside quotation marks, or next to a word that speaks of
  words ("word", "called", "said" ... whatever the labels show), is quoted. The
  features of a document (exact, near and quoted matches, their weights, their
  share) go into a small logistic regression fitted on the same sample.

Null and empty texts have no match and get the score of a document without one;
repeated rows are all scored; an empty table gives no rows; without labelled
rows the lexicon is empty and every score is 0.5. Only ``doc_id`` and ``text``
are read of the documents' columns.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import by_size, stored, texts_of

MAX_DOCS = 20_000
MAX_TERMS = 4000
FUZZY_FROM, FUZZY_2_FROM = 5, 12
WINDOW = 4
#: Words a worker remembers the matches of before it starts anew.
MAX_WORDS = 1_000_000


_K = 0x9E3779B97F4A7C15


def _gram(*letters):
    """Key of some letters (numbers or arrays); equal letters, equal keys."""
    key = letters[0]
    for c in letters[1:]:
        key = (key * _K + c) & (1 << 64) - 1 if isinstance(c, int) else key * np.uint64(_K) + c
    return key


def _poly(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that stand one after another or apart, and of each word
    without each of its letters."""
    from cairn.llm.wordids import _INV, _powers, gather, mix

    b, inv = _powers(len(codes))
    v = mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * b[: len(codes)])))
    size = ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    p = gather(np.arange(len(codes), dtype=np.int64), starts, size)
    s, e = starts[word], ends[word]
    less = ((c[p] - c[s]) + (c[e] - c[p + 1]) * np.uint64(_INV)) * inv[s]
    return (c[ends] - c[starts]) * inv[starts], less


class Lexicon:
    """Weighted terms in a trie. Terms of weight 0 are known words that match nothing."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.root: dict = {}
        for t in (t for t, w in terms.items() if w):
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

        self._tables()

    def _tables(self) -> None:
        """What a word near a term must hold: for one edit, the term or the
        word without one letter; for two, a third of the term at its place or
        two letters beside it."""
        from cairn.llm.wordids import HashIndex, to_codes

        live = [t for t, w in self.terms.items() if w]
        short = {t for t in live if len(t) >= FUZZY_FROM}
        short |= {t[:i] + t[i + 1 :] for t in short for i in range(len(t))}
        one = sorted(short | set(live))
        self.one = HashIndex()
        flat = to_codes("".join(one))
        at = np.concatenate(([0], np.cumsum([len(t) for t in one]))).astype(np.int64)
        self.one.add(np.unique(_poly(flat, at[:-1], at[1:])[0]))
        part: dict[int, int] = {}
        for t in live:
            if len(t) >= FUZZY_2_FROM:
                n = len(t)
                for p in (0, n // 3, 2 * n // 3):
                    key = _gram(*(ord(c) for c in t[p : p + 4]))
                    for q in range(max(0, p - 2), min(62, p + 2) + 1):
                        part[key] = part.get(key, 0) | 1 << q
        self.part = HashIndex()
        self.part.add(np.array(list(part), dtype=np.uint64))
        self.places = np.array([*part.values(), 0], dtype=np.uint64)

    def near(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Edits within which ``match`` may find each word, 0 if it can't."""
        ok = np.zeros(len(starts), dtype=np.int8)
        if not len(starts) or not self.root:
            return ok
        whole, less = _poly(codes, starts, ends)
        ok[self.one.find(whole) >= 0] = 1
        size = ends - starts
        word = np.repeat(np.arange(len(starts)), size)
        ok[word[self.one.find(less) >= 0]] = 1
        if self.part.n:
            long = np.flatnonzero(size >= FUZZY_2_FROM - 2)
            n = size[long] - 3
            word = np.repeat(long, n)
            place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
            p = starts[word] + place
            c = codes.astype(np.uint64)
            k = self.part.find(_gram(c[p], c[p + 1], c[p + 2], c[p + 3]))
            hit = (k >= 0) & (place < 63)
            ok[word[hit][(self.places[k[hit]] >> place[hit].astype(np.uint64)) & np.uint64(1) > 0]] = 2
        return ok

    def match(self, word: str, within: int = 2) -> tuple[str, int] | None:
        """The nearest term within the allowed edits (ties: larger weight, then
        alphabetic) and the number of edits; ``within`` is what ``near`` says."""
        if word in self.terms:
            return (word, 0) if self.terms[word] else None
        n = len(word)
        if n < FUZZY_FROM - 1:
            return None
        most = min(within, 2 if n >= FUZZY_2_FROM - 2 else 1)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | (2 << i)
        end, best = 1 << n, None
        # alive[e]: bit i set if some way reaches "i letters read, e edits made"
        stack = [(self.root, 1, 3, 7 if most == 2 else 0)]
        while stack:
            node, r0, r1, r2 = stack.pop()
            for c, child in node.items():
                if c == "":
                    e = 0 if r0 & end else 1 if r1 & end else 2 if r2 & end else 3
                    if e <= most and len(child) >= (FUZZY_FROM, FUZZY_FROM, FUZZY_2_FROM)[e]:
                        key = (e, -self.terms[child], child)
                        if best is None or key < best:
                            best = key
                    continue
                m = masks.get(c, 0)
                s0 = (r0 << 1) & m
                s1 = ((r1 << 1) & m) | r0 | (r0 << 1) | (s0 << 1)
                s2 = (((r2 << 1) & m) | r1 | (r1 << 1) | (s1 << 1)) if most == 2 else 0
                if s0 | s1 | s2:
                    stack.append((child, s0, s1, s2))
        return (best[2], best[0]) if best else None


def words_of(texts: list[str]):
    """Words (runs of letters, lower case) of some texts: code points, spans, document numbers."""
    from cairn.llm.quality import kinds
    from cairn.llm.wordids import to_codes

    low = [t.lower() for t in texts]
    codes = to_codes("".join(low))
    at = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    if not len(codes):
        z = np.zeros(0, dtype=np.int64)
        return low, codes, z, z, z, at
    kind = kinds(codes)
    letter = (kind == 1) | (kind == 2)
    cut = np.ones(len(codes) + 1, dtype=bool)
    np.not_equal(letter[1:], letter[:-1], out=cut[1:-1])
    cut[at] = True
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], len(codes))
    keep = letter[starts]
    starts, ends = starts[keep], ends[keep]
    return low, codes, starts, ends, np.searchsorted(at, starts, side="right") - 1, at


OPEN, CLOSE, BOTH = "“„«‹「", "”»›」", "\""


def quoted(text: str, a: int, b: int) -> bool:
    """Is text[a:b] inside quotation marks on its line?"""
    line = text.rfind("\n", 0, a) + 1
    before = text[line:a]
    if sum(before.count(c) for c in OPEN) > sum(before.count(c) for c in CLOSE):
        return True
    end = text.find("\n", b)
    after = text[b : end if end >= 0 else len(text)]
    if before.count('"') % 2 and '"' in after:
        return True
    return a > 0 and b < len(text) and text[a - 1] in "'‘`" and text[b] in "'’`"


def _marks(codes: np.ndarray, at: np.ndarray, starts: np.ndarray):
    """Running counts of '"' and of open marks, and where each word's line begins."""
    depth = np.isin(codes, [ord(c) for c in OPEN]).astype(np.int64) - np.isin(codes, [ord(c) for c in CLOSE])
    line = np.zeros(len(codes) + 1, dtype=np.int64)
    line[at[at < len(codes)]] = at[at < len(codes)]
    ends = np.flatnonzero(codes == 10) + 1
    line[ends] = ends
    line = np.maximum.accumulate(line)[starts]
    both, deep = (np.concatenate(([0], np.cumsum(x))) for x in (codes == 34, depth))
    return both, deep, line


def in_marks(codes: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word, does an odd number of '"', or more opening than closing
    marks, stand before it on its line?"""
    both, deep, line = _marks(codes, at, starts)
    return ((both[starts] - both[line]) % 2 == 1) | (deep[starts] > deep[line])


def quoted_words(codes: np.ndarray, at: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``quoted`` of the words ``which``, all lines gone through once."""
    s, e, d = starts[which], ends[which], doc[which]
    both, deep, line = _marks(codes, at, s)
    # the end of the word's line: the next line break, or the end of the text
    breaks = np.append(np.flatnonzero(codes == 10), len(codes))
    stop = np.minimum(breaks[np.searchsorted(breaks, e)], at[d + 1])
    out = (deep[s] > deep[line]) | (((both[s] - both[line]) % 2 == 1) & (both[stop] > both[e]))
    inner = (s > at[d]) & (e < at[d + 1])
    before, after = codes[s[inner] - 1], codes[e[inner]]
    out[inner] |= np.isin(before, [ord(c) for c in "'‘`"]) & np.isin(after, [ord(c) for c in "'’`"])
    return out


class Matcher:
    """Matches of whole texts, with the verdict on each distinct word kept."""

    def __init__(self, lexicon: Lexicon, mention: frozenset):
        self.lexicon, self.mention = lexicon, mention
        self._reset()

    def _reset(self):
        from cairn.llm.wordids import HashIndex

        self.index = HashIndex()
        self.found: dict = {}
        self.hit = np.zeros(1 << 16, dtype=bool)

    def spans(self, texts: list[str]):
        """(document number, term, edits, is it in quotation marks, words
        beside it) of every match, and the words per document."""
        from cairn.llm.wordids import Words, span_hashes

        low, codes, starts, ends, doc, at = words_of(texts)
        n_words = np.bincount(doc, minlength=len(texts))
        if not len(starts):
            return [], n_words
        if self.index.n > MAX_WORDS:
            self._reset()
        h = span_hashes(codes, starts, ends)
        e = self.index.find(h)
        miss = np.flatnonzero(e < 0)
        if len(miss):
            _, first = np.unique(h[miss], return_index=True)
            which = miss[first]
            got: list = [None] * len(which)
            within = self.lexicon.near(codes, starts[which], ends[which])
            maybe = np.flatnonzero(within)
            for k, w in zip(maybe.tolist(), Words(codes, starts, ends, None).strings(which[maybe])):
                got[k] = self.lexicon.match(w, int(within[k]))
            base = self.index.n
            while base + len(got) > len(self.hit):
                self.hit = np.concatenate((self.hit, np.zeros_like(self.hit)))
            self.hit[base : base + len(got)] = [g is not None for g in got]
            self.found.update((base + k, g) for k, g in enumerate(got) if g)
            self.index.add(h[which])
            e[miss] = self.index.find(h[miss])
        out = []
        hits = np.flatnonzero(self.hit[e])
        marked = quoted_words(codes, at, doc, starts, ends, hits)
        for k, mark in zip(hits.tolist(), marked.tolist()):
            d = int(doc[k])
            word = lambda j, d=d: low[d][int(starts[j] - at[d]) : int(ends[j] - at[d])]
            near = [word(j) for j in range(max(0, k - WINDOW), min(len(starts), k + WINDOW + 1)) if j != k and doc[j] == d]
            out.append((d, *self.found[int(e[k])], mark, near))
        return out, n_words

    def matches(self, texts: list[str]):
        """(document number, term, edits, is it quoted) of every match, and the words per document."""
        spans, n_words = self.spans(texts)
        return [(d, term, edits, q or not self.mention.isdisjoint(near)) for d, term, edits, q, near in spans], n_words


N_FEATURES = 9


def features(matches, n_words: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """One row per document: matches exact, near, quoted (log), their weights, their share of the words."""
    x = np.zeros((len(n_words), N_FEATURES))
    best = np.zeros((len(n_words), 2))
    for d, term, edits, is_quoted in matches:
        w = weights[term]
        k = 2 if is_quoted else 1 if edits else 0
        x[d, k] += 1
        x[d, 3 + k] += w
        if not is_quoted:
            best[d, min(edits, 1)] = max(best[d, min(edits, 1)], w)
    share = (x[:, 0] + x[:, 1]) / np.maximum(n_words, 1)
    x[:, :6] = np.log1p(x[:, :6])
    x[:, 6] = np.sqrt(share) * 5
    x[:, 7:9] = best
    return x


def _gain(a, b, n1: int, n0: int):
    """How far (a, b) toxic and other documents are from the mix of all, as a log-likelihood ratio."""
    p, q = (n1 + 1) / (n1 + n0 + 2), (n0 + 1) / (n1 + n0 + 2)
    n = F.greatest(a + b, F.lit(1))
    part = lambda x, r: F.when(x > 0, x * F.log(x / (n * r))).otherwise(0.0)
    return 2 * (part(a, p) + part(b, q))


def learn_lexicon(seen: DataFrame, max_terms: int = MAX_TERMS, min_odds: float = 3.0, min_gain: float = 22.0) -> dict[str, float]:
    """Terms with their weights (log odds), a "known" word of weight 0 for every
    word of other documents that a term would catch. ``seen``: (text, y) of a
    bounded sample, whose words are counted in Spark."""

    def count(batches):
        import pyarrow as pa

        from cairn.llm.wordids import Words, span_hashes

        for whole in batches:
            for b in by_size(whole):
                y = np.array(b.column("y").to_pylist(), dtype=np.int64)
                _, codes, starts, ends, doc, at = words_of(b.column("text").to_pylist())
                free = ~in_marks(codes, at, starts)  # quoted words say nothing about who wrote them
                starts, ends, doc = starts[free], ends[free], doc[free]
                if not len(starts):
                    continue
                h = span_hashes(codes, starts, ends)
                _, first, inv = np.unique(h, return_index=True, return_inverse=True)
                pair = np.unique(inv.astype(np.int64) * b.num_rows + doc)
                toxic = np.bincount(pair // b.num_rows, weights=y[pair % b.num_rows], minlength=len(first)).astype(np.int64)
                every = np.bincount(pair // b.num_rows, minlength=len(first))
                words = Words(codes, starts, ends, None).strings(first)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic), pa.array(every - toxic)], names=["term", "a", "b"])

    n = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    counts = stored(seen.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "terms")
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    top = counts.withColumn("w", odds).where((F.length("term") >= 3) & (F.col("w") >= min_odds) & (_gain(F.col("a"), F.col("b"), n1, n0) >= min_gain))
    top = top.orderBy(F.desc("w"), F.desc("a"), "term").limit(max_terms).collect()  # at most max_terms rows
    terms = {r["term"]: float(r["w"]) for r in top}

    def near(batches):
        import pyarrow as pa

        from cairn.llm.wordids import to_codes

        lexicon = Lexicon(terms)
        for b in batches:
            words = b.column(0).to_pylist()
            at = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
            within = lexicon.near(to_codes("".join(words)), at[:-1], at[1:]).tolist()
            words = [w for w, e in zip(words, within) if e and w not in terms and lexicon.match(w, e)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["term"])

    known = counts.where((F.col("b") >= 2) & (F.col("b") * (n1 + 1) >= F.col("a") * (n0 + 1))).select("term").mapInArrow(near, "term string").collect() if terms else []
    return terms | {r["term"]: 0.0 for r in known}


def learn_mention(seen: DataFrame, terms: dict[str, float], min_docs: int = 5, max_words: int = 500) -> frozenset:
    """Words that stand beside terms mostly in documents that aren't toxic."""

    def count(batches):
        import pyarrow as pa

        m = Matcher(Lexicon(terms), frozenset())
        for whole in batches:
            for b in by_size(whole):
                y = b.column("y").to_pylist()
                pairs = {(d, w) for d, _, _, _, near in m.spans([t or "" for t in b.column("text").to_pylist()])[0] for w in near}
                rows = [(w, y[d], 1 - y[d]) for d, w in sorted(pairs)]
                cols = list(zip(*rows)) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()))], names=["w", "a", "b"])

    if not terms:
        return frozenset()
    counts = seen.mapInArrow(count, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    top = counts.where((F.col("b") >= min_docs) & (F.col("b") > 3 * F.col("a"))).orderBy(F.desc("b"), "w").limit(max_words).collect()
    return frozenset(r["w"] for r in top)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _measured(rows: DataFrame, shared, keep: list[str], names: list[str], kinds: str, finish) -> DataFrame:
    """Columns ``keep`` of the rows and what ``finish`` makes of their features and matches."""

    def run(batches):
        import pyarrow as pa

        terms, mention = shared.value[:2]
        m = Matcher(Lexicon(terms), mention)
        for whole in batches:
            for b in by_size(whole):
                found, n = m.matches([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + finish(features(found, n, terms), found, shared.value), names=keep + names)

    return rows.mapInArrow(run, kinds)


def _columns(x, found, model):
    import pyarrow as pa

    return [pa.array(list(x), pa.list_(pa.float64()))]


def _scores(x, found, model):
    import pyarrow as pa

    w = model[2]
    s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    hits: dict[int, list] = {}
    for d, term, edits, is_quoted in found:
        hits.setdefault(d, []).append({"term": term, "edits": edits, "quoted": bool(is_quoted)})
    kind = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))
    return [pa.array(s, pa.float64()), pa.array([hits.get(k, []) for k in range(len(s))], kind)]


def fit(docs: DataFrame, sample: DataFrame):
    """(terms, words of mention, weights) from a bounded (doc_id, y) sample."""
    spark = docs.sparkSession
    seen = texts_of(docs).join(F.broadcast(sample), "doc_id").select("text", "y")
    # Terms come from one half of the sample and the weights from the other, so a chance term gets the weight it has on rows that didn't choose it.
    half = F.pmod(F.xxhash64("text"), F.lit(3)) != 0
    terms = learn_lexicon(seen.where(half))
    mention = learn_mention(seen.where(half), terms)
    shared = spark.sparkContext.broadcast((terms, mention))
    rows = _measured(seen.where(~half), shared, ["y"], ["x"], "y int, x array<double>", _columns).collect()  # N_FEATURES numbers for each row of the sample
    y = np.array([r["y"] for r in rows], dtype=float)
    if not len(rows) or y.min() == y.max():
        w = np.zeros(N_FEATURES + 1)
        if len(rows):
            w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return terms, mention, w
    return terms, mention, logistic(np.array([r["x"] for r in rows]), y)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, text, toxicity (0 to 1), matches (term, edits, quoted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _measured(texts_of(docs), shared, ["doc_id", "text"], ["toxicity", "matches"],
                     "doc_id long, text string, toxicity double, matches array<struct<term:string,edits:int,quoted:boolean>>", _scores)


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    from cairn.llm.quality import labelled_sample

    return score(docs, fit(docs, labelled_sample(labels, "toxic", max_docs)))
