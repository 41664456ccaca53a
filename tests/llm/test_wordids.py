import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import wordids

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
HARD = ["", " ", "  ", "\n\n  x", "a  b", "a \n b\t", "it's 'sing 're'll don't' 's \n's", "x '", "'", "''s", " 's", "I'LL we'd we'ddd",
        "1234 5 ٣٤", "a<|endoftext|>b <|endoftext|>", "<|startoftext|>", "ÉÀ İstanbul ΣΑΣ ß", "é ö", "　中文 文字。", "😀😀 x", "\x00\x1c\x1f\x85\xa0a",
        "a" * 5000, " " * 3000 + "b", "$%&!! ##|| 's"]


@pytest.mark.parametrize("name", FILES)
def test_equals_library_on_hard_texts(name):
    path = public_tokenizers.path(name)
    t, e = Tokenizer.from_file(path), wordids.Encoder(path)
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice(["'", "s", "ll", " ", "\n", "1", "é", "|", "re", "A", " ", "中"]) for _ in range(60)) for _ in range(400)]
    got = dict(e.encode(texts))
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        assert got[i].tolist() == t.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(max_size=40), max_size=6))
def test_equals_library_on_any_text(name, texts):
    path = public_tokenizers.path(name)
    t, e = Tokenizer.from_file(path), wordids.encoder(path)
    assert [x.tolist() for _, x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_text_is_cut_between_words(monkeypatch):
    monkeypatch.setattr(wordids, "CHUNK", 2000)
    for name in FILES:
        path = public_tokenizers.path(name)
        t, e = Tokenizer.from_file(path), wordids.Encoder(path)
        rng = random.Random(1)
        x = "".join(rng.choice(["ab", " ", "'s", "\n", "  ", "7", "|"]) for _ in range(9000))
        assert [i.tolist() for _, i in e.encode([x, None, "z"])] == [t.encode(y, add_special_tokens=False).ids for y in (x, "", "z")]
