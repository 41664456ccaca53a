"""Exact, vectorised word splitting and encoding for the public BPE files.

A byte-pair encoder treats every pre-token ("word") alone, so a text's ids are
the concatenation of its words' ids. Splitting is done with numpy over code
points (class table, run boundaries), the words are looked up by a 64-bit
content hash, and only words not seen before in this Python worker go through
the ``tokenizers`` library. The code point classes (letter, number, space,
other) are asked from the tokenizer itself, so its Unicode version counts.

Two split rules are known, the ones of the two tokenizer files used:

* ``byte``: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
* ``word``: ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+`` on the
  normalised (NFC, lower case) text, white space dropped.

Strings of added tokens inside a text are recognised as the library does.
"""

from __future__ import annotations

import json
import re

import numpy as np

S, L, N, P = 0, 1, 2, 3
_B = 6364136223846793005
_INV = pow(_B, -1, 1 << 64)
#: Code points handled together; longer texts are cut at single spaces, where no word can span.
CHUNK = 1 << 19
#: Words remembered by a Python worker before its cache starts anew.
MAX_WORDS = 800_000

_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("b", ())) < n + 1:
        m = max(n + 1, CHUNK + (CHUNK >> 2))
        for name, base in (("b", _B), ("i", _INV)):
            a = np.full(m, base, dtype=np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW["b"], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points (equal spans, equal hashes)."""
    b, inv = _powers(len(codes))
    v = mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    v *= b[: len(codes)]
    c = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(v, out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def to_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gather(flat: np.ndarray, off: np.ndarray, ln: np.ndarray) -> np.ndarray:
    """Concatenation of flat[off[i]: off[i] + ln[i]] over all i."""
    total = int(ln.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(ln)
    idx = np.arange(total, dtype=np.int64)
    idx += np.repeat(off - (ends - ln), ln)
    return flat[idx]


class HashIndex:
    """Open-addressing map from 64-bit hashes to 0, 1, 2, ... in order of insertion."""

    def __init__(self, bits: int = 16):
        self._new(bits)
        self.n = 0

    def _new(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.vals = np.full(1 << bits, -1, dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 where unknown."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        out = self.vals[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            s = slot[todo]
            v = self.vals[s]
            out[todo] = v
            todo = todo[(v >= 0) & (self.keys[s] != h[todo])]
        return out

    def add(self, h: np.ndarray) -> None:
        """Insert distinct, unknown hashes."""
        if 2 * (self.n + len(h)) > self.mask:
            old = self.keys[self.vals >= 0], self.vals[self.vals >= 0]
            self._new(int(2 * (self.n + len(h))).bit_length() + 1)
            self._put(*old)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, v: np.ndarray) -> None:
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = self.vals[s] < 0
            self.vals[s[free]] = v[todo[free]]  # of several for one slot, the last stays
            won = self.vals[s] == v[todo]
            self.keys[s[won]] = h[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask


class Words:
    """Words of some texts: code points, spans, and per text the first word's number."""

    __slots__ = ("codes", "starts", "ends", "first")

    def __init__(self, codes, starts, ends, first):
        self.codes, self.starts, self.ends, self.first = codes, starts, ends, first

    def hashes(self) -> np.ndarray:
        return span_hashes(self.codes, self.starts, self.ends)

    def strings(self, which: np.ndarray) -> list[str]:
        raw = self.codes.tobytes()
        return [raw[4 * a : 4 * b].decode("utf-32-le", "surrogatepass")
                for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]


_CUT = re.compile(r"(?<=[^\s])[ \n](?=[^\s])")
_NOT_LATIN = re.compile("[^\x00-ɏ]")


class Splitter:
    """Word boundaries of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words_only = (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel"
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._cls = np.full(0x110000, 255, dtype=np.uint8)

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        cls = self._cls[codes]
        new = np.unique(codes[cls == 255])
        if len(new):
            split = self.tok.pre_tokenizer.pre_tokenize_str
            for c in new.tolist():
                ch = chr(c) if not 0xD800 <= c < 0xE000 else "�"
                if len(split("a" + ch)) == 1 and len(split(ch)) == 1:
                    k = L
                elif len(split("!" + ch)) == 1 and len(split(ch)) == 1:
                    k = P
                elif (self.words_only and split(ch)) or (not self.words_only and len(split("1" + ch)) == 1):
                    k = N
                else:
                    k = S
                self._cls[c] = k
            cls = self._cls[codes]
        return cls

    def normal(self, text: str) -> str:
        if not self.words_only:
            return text
        if text.isascii() or not _NOT_LATIN.search(text):
            return text.lower()
        return self.tok.normalizer.normalize_str(text)

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """(part, is it an added token) of a text, cut where no word can span."""
        out = []
        parts = [text]
        if self._added is not None and any(a in text for a in self.added):
            parts = self._added.split(text)
        for k, part in enumerate(parts):
            if k % 2:
                out.append((part, True))
                continue
            part = self.normal(part)
            at = 0
            while len(part) - at > CHUNK:
                m = _CUT.search(part, at + CHUNK // 2)
                if not m:
                    break
                out.append((part[at : m.start()], False))
                at = m.start()
            if at < len(part):
                out.append((part[at:], False))
        return out

    def chunks(self, texts):
        """Groups of (text number, parts) of about CHUNK code points; a long text may span several."""
        rows, size = [], 0
        for i, t in enumerate(texts):
            parts = self.pieces(t)
            if not parts:
                rows.append((i, "", False))
            for p, forced in parts:
                rows.append((i, p, forced))
                size += len(p)
                if size >= CHUNK:
                    yield rows
                    rows, size = [], 0
        if rows:
            yield rows

    def split(self, rows) -> Words:
        """Words of one chunk; ``first`` is by row of the chunk."""
        codes = to_codes("".join(r[1] for r in rows))
        ln = np.array([len(r[1]) for r in rows], dtype=np.int64)
        at = np.concatenate(([0], np.cumsum(ln)))
        n = len(codes)
        if not n:
            z = np.zeros(0, dtype=np.int64)
            return Words(codes, z, z, np.zeros(len(rows) + 1, dtype=np.int64))
        cls = self._classes(codes)
        seg = np.zeros(n + 1, dtype=bool)
        seg[at] = True
        forced = [k for k, r in enumerate(rows) if r[2]]
        if forced:
            cls = cls.copy()
            for k in forced:
                cls[at[k] : at[k + 1]] = P
        new = np.empty(n + 1, dtype=bool)
        new[0] = new[n] = True
        np.not_equal(cls[1:], cls[:-1], out=new[1:n])
        new |= seg
        b = new.copy()
        sp = cls == S
        if not self.words_only:
            # last white space character before another run of the same part
            last = np.flatnonzero(sp & new[1:] & ~seg[1:])
            b[last] = True
            b[last[codes[last] == 32] + 1] = False
        apos = np.flatnonzero(codes == 39)
        if len(apos):
            apos = apos[(apos + 1 < n)]
            apos = apos[b[apos] & new[apos] & new[apos + 1] & ~seg[apos + 1] & (cls[apos + 1] == L)]
            if len(apos):
                one = np.isin(codes[apos + 1], (115, 116, 109, 100))
                p2 = np.minimum(apos + 2, n - 1)
                pair = codes[apos + 1].astype(np.int64) * 65536 + codes[p2]
                two = (apos + 2 < n) & ~new[p2] & np.isin(pair, (114 * 65536 + 101, 118 * 65536 + 101, 108 * 65536 + 108))
                for hit, k in ((apos[one], 1), (apos[two & ~one], 2)):
                    b[hit + 1] = False
                    b[hit + 1 + k] = True
        if self.words_only:
            b[:n] |= cls == N
        for k in forced:
            b[at[k] + 1 : at[k + 1]] = False
        starts = np.flatnonzero(b[:n])
        ends = np.append(starts[1:], n)
        if self.words_only:
            keep = cls[starts] != S
            starts, ends = starts[keep], ends[keep]
        return Words(codes, starts, ends, np.searchsorted(starts, at))


class Encoder(Splitter):
    """Ids of whole texts, with the ids of words seen before kept in the worker."""

    def __init__(self, path: str):
        super().__init__(path)
        self._reset()

    def _reset(self) -> None:
        self.index = HashIndex()
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.off = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and their counts."""
        e = self.tok.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, dtype=np.uint32)
        ln = np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(words)) if len(ids) else np.zeros(len(words), np.int64)
        return ids, ln

    def _learn(self, words: Words, h: np.ndarray, miss: np.ndarray) -> None:
        _, first = np.unique(h[miss], return_index=True)
        which = miss[first]
        for a in range(0, len(which), 20_000):
            part = which[a : a + 20_000]
            ids, ln = self.word_ids(words.strings(part))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while self.index.n + len(part) + 1 > len(self.off):
                self.off = np.concatenate((self.off, np.zeros_like(self.off)))
            self.flat[self.used : self.used + len(ids)] = ids
            self.off[self.index.n + 1 : self.index.n + len(part) + 1] = self.used + np.cumsum(ln)
            self.used += len(ids)
            self.index.add(h[part])

    def encode_chunk(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunk, ids before each row of it and the end)."""
        if self.index.n > MAX_WORDS:
            self._reset()
        w = self.split(rows)
        h = w.hashes()
        e = self.index.find(h)
        miss = np.flatnonzero(e < 0)
        if len(miss):
            self._learn(w, h, miss)
            e[miss] = self.index.find(h[miss])
        off = self.off[e]
        ln = self.off[e + 1] - off
        ids = gather(self.flat, off, ln)
        return ids, np.concatenate(([0], np.cumsum(ln)))[w.first]

    def encode(self, texts):
        """Yields (text number, ids) in order; a null text counts as empty."""
        held, held_i = [], None
        texts = ["" if t is None else t for t in texts]
        for rows in self.chunks(texts):
            ids, at = self.encode_chunk(rows)
            for k, r in enumerate(rows):
                part = ids[at[k] : at[k + 1]]
                if r[0] == held_i:
                    held.append(part)
                    continue
                if held_i is not None:
                    yield held_i, held[0] if len(held) == 1 else np.concatenate(held)
                held, held_i = [part], r[0]
        if held_i is not None:
            yield held_i, held[0] if len(held) == 1 else np.concatenate(held)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
