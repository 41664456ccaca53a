"""BPE encoding through a distinct-word table, and decoding.

``encode``: texts are split into words in blocks of about ``block_chars``
code points. A block keeps, per document, the numbers of its words, and a list
of its distinct words. The distinct words of all blocks meet by word; each word
is encoded once, and its ids go back to (block, number). A block then reads its
documents' ids off by position. So what is shuffled per word is one row per
block in which it occurs, and the hottest word has as many rows as any other
word that all blocks hold.

The split runs twice (once for the words, once for the numbers), so ``docs``
must give the same rows in the same order when read again, as a stored table
does. Blocks are named by partition, order and a digest of their texts, and
each block checks that it got ids for all its words, so a table that changed in
between makes the job fail instead of giving wrong ids.

``decode`` joins ids with their pieces. The table of pieces has one row per id
of the vocabulary, so its size is fixed by the tokenizer; the join is a lookup
by id inside the task.

Null texts are empty and give no ids; repeated rows are kept; an empty table
gives no rows; of other columns only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import by_size, texts_of

BLOCK_CHARS = 28 << 20
ENCODED = "doc_id long, ids binary"


class _Block:
    """Words of one block in the making."""

    def __init__(self, part: int, seq: int):
        from cairn.llm.wordids import HashIndex

        self.part, self.seq, self.size, self.sum = part, seq, 0, 0
        self.index, self.words, self.docs = HashIndex(), [], []

    def name(self) -> str:
        return f"{self.part}-{self.seq}-{self.sum:08x}"

    def add(self, split, keys: list, texts: list[str]) -> None:
        import zlib

        held: list[np.ndarray] = []
        last = None
        for rows in split.chunks(texts):
            w = split.split(rows)
            h = w.hashes()
            e = self.index.find(h)
            miss = np.flatnonzero(e < 0)
            if len(miss):
                _, first = np.unique(h[miss], return_index=True)
                which = miss[np.sort(first)]
                self.index.add(h[which])
                self.words += w.strings(which)
                e[miss] = self.index.find(h[miss])
            self.sum = zlib.crc32(h.tobytes(), self.sum)
            for k, r in enumerate(rows):
                part = e[w.first[k] : w.first[k + 1]]
                if r[0] != last and last is not None:
                    self.docs.append((keys[last], np.concatenate(held)))
                    held = []
                held.append(part)
                last = r[0]
            self.size += sum(len(r[1]) for r in rows)
        if last is not None:
            self.docs.append((keys[last], np.concatenate(held)))


def _blocks(path: str, block_chars: int, emit):
    def run(batches):
        from pyspark import TaskContext

        from cairn.llm.wordids import Splitter

        split, part = Splitter(path), TaskContext.get().partitionId()
        block = _Block(part, 0)
        for whole in batches:
            for b in by_size(whole):
                block.add(split, b.column(0).to_pylist(), b.column(1).to_pylist())
                if block.size >= block_chars:
                    yield from emit(block)
                    block = _Block(part, block.seq + 1)
        if block.docs:
            yield from emit(block)

    return run


def _emit_words(block: _Block):
    import pyarrow as pa

    n, name = len(block.words), block.name()
    for a in range(0, n, 50_000):
        z = min(a + 50_000, n)
        yield pa.RecordBatch.from_arrays([pa.array(block.words[a:z], pa.string()), pa.array([name] * (z - a), pa.string()), pa.array(np.arange(a, z, dtype=np.int32))],
                                         names=["word", "block", "nr"])


def _emit_docs(block: _Block):
    import pyarrow as pa
    import zstandard

    z, name, n = zstandard.ZstdCompressor(level=3), block.name(), len(block.words)
    kind = "<u2" if n <= 1 << 16 else "<u4"
    for a in range(0, len(block.docs), 500):
        part = block.docs[a : a + 500]
        blob = np.concatenate([x for _, x in part]).astype(kind)
        planes = blob.view(np.uint8).reshape(len(blob), -1).T.tobytes()  # byte by byte: the high ones are mostly alike
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int32()), pa.array([[k for k, _ in part]], pa.list_(pa.int64())),
                                          pa.array([[len(x) for _, x in part]], pa.list_(pa.int64())), pa.array([z.compress(planes)], pa.binary())],
                                         names=["block", "n_words", "doc_ids", "lengths", "numbers"])


def _encode_sorted(path: str):
    """Rows (word, block, nr) sorted by word: each distinct word is encoded
    once, and its ids are put together by block, about a million at a time."""

    def flush(words, blocks, nr, enc, last, z):
        import pyarrow as pa

        from cairn.llm.wordids import gather

        d = pa.concat_arrays(words).dictionary_encode()
        table = d.dictionary.to_pylist()
        # the first word may go on from the rows before
        new = table[1:] if last and table[0] == last[0] else table
        ids, ln = enc.word_ids(new) if new else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if len(new) < len(table):
            ids, ln = np.concatenate((last[1], ids)), np.concatenate(([len(last[1])], ln))
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(ln)))
        last = (table[-1], ids[ends[-2] :])
        names = pa.concat_arrays(blocks).dictionary_encode()
        codes, word, nr = names.indices.to_numpy(), d.indices.to_numpy(), np.concatenate(nr)
        order = np.argsort(codes, kind="stable")
        cuts = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1)).tolist()
        rows = []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            at = order[a:b]
            w = word[at]
            blob = nr[at].astype("<i4").tobytes() + ln[w].astype("<u4").tobytes() + gather(ids, ends[:-1][w], ln[w]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            rows.append((names.dictionary[k].as_py(), b - a, z.compress(blob)))
        return last, pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], names=["block", "n", "packed"])

    def run(batches):
        import zstandard

        from cairn.llm.wordids import encoder

        enc, z, last, n = encoder(path), zstandard.ZstdCompressor(level=3), None, 0
        words, blocks, nr = [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            words.append(b.column("word"))
            blocks.append(b.column("block"))
            nr.append(b.column("nr").to_numpy())
            n += b.num_rows
            if n >= 1_000_000:
                last, out = flush(words, blocks, nr, enc, last, z)
                yield out
                words, blocks, nr, n = [], [], [], 0
        if n:
            yield flush(words, blocks, nr, enc, last, z)[1]

    return run


def _read_off(kind: str):
    """Ids of a block's documents, as numbers of a kind."""

    def run(key, docs, words):
        import zstandard

        from cairn.llm.wordids import gather

        if not len(docs):
            return pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "ids": pd.Series(dtype=object)})
        z, n = zstandard.ZstdDecompressor(), int(docs["n_words"].iloc[0])
        ln, parts, got = np.zeros(n, dtype=np.int64), [], 0
        for k, blob in zip(words["n"], words["packed"]):
            raw = z.decompress(blob)
            nr, m = np.frombuffer(raw, "<i4", k), np.frombuffer(raw, "<u4", k, 4 * k).astype(np.int64)
            ln[nr] = m
            ids = np.frombuffer(raw, np.uint8, offset=8 * k)
            parts.append((nr, m, np.ascontiguousarray(ids.reshape(4, -1).T).view("<u4").reshape(-1)))
            got += k
        if got != n:
            raise RuntimeError(f"block {key[0]}: {got} of its {n} words have ids; the table changed between two reads")
        off = np.concatenate((np.zeros(1, np.int64), np.cumsum(ln)))
        flat = np.zeros(int(off[-1]), dtype=kind)
        for nr, m, ids in parts:
            to = np.repeat(off[nr] - (np.cumsum(m) - m), m) + np.arange(len(ids))
            flat[to] = ids
        keys, out = [], []
        for ids_of, lengths, blob in zip(docs["doc_ids"], docs["lengths"], docs["numbers"]):
            raw = np.frombuffer(z.decompress(blob), dtype=np.uint8)
            width, total = (2, "<u2") if n <= 1 << 16 else (4, "<u4"), int(np.sum(lengths))
            e = np.ascontiguousarray(raw.reshape(width[0], total).T).view(width[1]).reshape(-1).astype(np.int64)
            at = np.concatenate(([0], np.cumsum(np.asarray(lengths, dtype=np.int64))))
            ids = gather(flat, off[e], ln[e])
            ends = np.concatenate(([0], np.cumsum(ln[e])))[at].tolist()
            raw, size = ids.tobytes(), ids.itemsize
            keys += list(ids_of)
            out += [raw[size * a : size * b] for a, b in zip(ends[:-1], ends[1:])]
        return pd.DataFrame({"doc_id": pd.array(keys, dtype="Int64"), "ids": out})

    return run


def width(path: str) -> int:
    """Bytes of an id in packed columns: 2 if the vocabulary's ids fit, else 4."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 2 if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) < 1 << 16 else 4


def encode(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) with the ids of each whole text as little-endian unsigned
    numbers of ``width(path)`` bytes (``unpack`` makes an array of them)."""
    t = texts_of(docs)
    words = t.mapInArrow(_blocks(path, block_chars, _emit_words), "word string, block string, nr int")
    # the table of distinct words lies in these partitions, each word in one of them, with its places beside it
    back = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_sorted(path), "block string, n int, packed binary")
    numbers = t.mapInArrow(_blocks(path, block_chars, _emit_docs), "block string, n_words int, doc_ids array<long>, lengths array<long>, numbers binary")
    return numbers.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(_read_off(f"<u{width(path)}"), ENCODED)


def unpack(ids: Column, path: str) -> Column:
    """Array of the ids in a packed column."""
    kind = f"<u{width(path)}"

    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, kind).astype(np.int64) for x in raw], dtype=object)

    return F.pandas_udf(run, "array<long>")(ids)


class Pieces:
    """The id-to-piece table of a byte-level vocabulary, and any other table of bytes by id."""

    def __init__(self, pieces: list[bytes]):
        self.ln = np.array([len(p) for p in pieces], dtype=np.int64)
        self.off = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.ln)))[:-1]
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        from cairn.llm.wordids import gather

        return gather(self.flat, self.off[ids], self.ln[ids]).tobytes()


def byte_pieces(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level file. Its vocabulary writes each byte
    as a printable character: those of Latin-1 that print stand for
    themselves, the others for U+0100 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max(vocab.values()) + 1)
    added = {t["id"] for t in spec.get("added_tokens", [])}
    for piece, i in vocab.items():
        out[i] = piece.encode() if i in added else bytes(of[c] for c in piece)
    return out


_PIECES: dict[tuple[str, str], Pieces] = {}


def _pieces(path: str, kind: str) -> Pieces:
    if (path, kind) not in _PIECES:
        table = byte_pieces(path)
        _PIECES[path, kind] = Pieces(table if kind == "bytes" else [f"{i},".encode() for i in range(len(table))])
    return _PIECES[path, kind]


def decode(encoded: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, ids, text): the pieces of a document's ids, joined by position;
    bytes that are no UTF-8 become U+FFFD. With ``digest`` also ids_sha256, the
    lowercase hex SHA-256 of the decimal ids joined by commas."""
    kind = f"<u{width(path)}"

    def run(batches):
        import hashlib

        import pyarrow as pa

        table, decimal = _pieces(path, "bytes"), _pieces(path, "decimal")
        for whole in batches:
            for b in by_size(whole, "ids", 1 << 20):
                ids = [np.frombuffer(x.as_buffer(), kind) for x in b.column("ids")]
                cols = [b.column("doc_id"), b.column("ids"), pa.array([table.join(x).decode("utf-8", "replace") for x in ids], pa.string())]
                names = ["doc_id", "ids", "text"]
                if digest:
                    cols.append(pa.array([hashlib.sha256(decimal.join(x)[:-1]).hexdigest() for x in ids], pa.string()))
                    names.append("ids_sha256")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string" + (", ids_sha256 string" if digest else ""))
