import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairn.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(3, "b c"), (1, None), (2, ""), (3, "b c"), (None, "null id"), (9, "wört " * 3000), (8, "it's 'sing <|endoftext|> x�"), (7, " \n"), (5, "中文 😀")]


@pytest.mark.parametrize("block_chars", [20, 1 << 20])
def test_equals_library_both_ways(docs_of, block_chars):
    t = Tokenizer.from_file(PATH)
    docs = docs_of([(a, b, "x") for a, b in ROWS], "doc_id long, text string, word string").repartition(2)
    enc = bpe.encode(docs, PATH, block_chars).persist()
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in enc.select("doc_id", bpe.unpack(enc.ids, PATH).alias("ids")).collect())
    want = [(d is None, d or 0, t.encode(x or "", add_special_tokens=False).ids) for d, x in ROWS]
    assert got == sorted(want)
    dec = {(r.doc_id, r.text) for r in bpe.decode(enc, PATH).collect()}
    assert dec == {(d, t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, x in ROWS}
    dig = {(r.doc_id, r.ids_sha256) for r in bpe.decode(enc, PATH, digest=True).collect()}
    assert dig == {(d, hashlib.sha256(",".join(map(str, t.encode(x or "", add_special_tokens=False).ids)).encode()).hexdigest()) for d, x in ROWS}


def test_empty_table(docs_of):
    assert bpe.decode(bpe.encode(docs_of([]), PATH), PATH).collect() == []


def test_pieces_are_the_library_s(docs_of):
    t = Tokenizer.from_file(PATH)
    table = bpe.byte_pieces(PATH)
    assert len(table) == t.get_vocab_size()
    for i in list(range(0, len(table), 997)) + [50256]:
        assert table[i].decode("utf-8", "replace") == t.decode([i], skip_special_tokens=False)
