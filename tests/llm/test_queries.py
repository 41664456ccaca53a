"""Registered queries against what they have to return."""

import hashlib
import zlib

from cairn.llm import queries as Q
from cairn.llm.common import read, tokenizer_path

SF = "/root/testdata/sf0.001"


def _docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in read(spark, SF, "documents").select("doc_id", "text").collect()}


def test_op1_columns_and_rules(spark):
    out = Q.op1_quality_ftrl(spark, SF)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(_docs(spark))
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_op2_digests(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    docs = _docs(spark)
    for r in Q.op2_bpe_words(spark, SF).collect():
        ids = t.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9_digests(spark):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs, start = _docs(spark), 0
    for r in sorted(Q.op9_huffman_ids(spark, SF).collect(), key=lambda r: r["doc_id"]):
        ids = [*t.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_op13_columns(spark):
    out = Q.op13_hadamard_clusters(spark, SF)
    assert out.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    rows = out.collect()
    assert {r["inertia"] for r in rows} == {sum(r["distance"] for r in rows)} and len({r["centroid_sha256"] for r in rows}) == len({r["cluster"] for r in rows})
