"""Embedding hook (V6) and re-embedding.

An ``Embedder`` turns a text column into a unit-length float vector column.
It runs as an Arrow-batched pandas UDF, so each Python worker loads its model
once and encodes whole batches (the reference encodes in batches of 32).

No sentence-embedding model is installed here, so the default is
``HashEmbedder``: signed feature hashing of lower-cased word tokens into 384
dimensions, L2-normalised. It keeps the shape, the unit norm and lexical
overlap of real embeddings, not their semantics. Its hash is md5, so any SQL
engine can compute the same vectors. Plug a model in by subclassing
``Embedder.encode``.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import schema as S

_TOKEN = re.compile(r"[^\W_]+|_+", re.UNICODE)


class Embedder:
    """Text -> unit vector. Subclasses implement ``encode``."""

    name = "embedder"
    dim = S.EMBED_DIM
    batch_size = S.EMBED_BATCH

    def encode(self, texts: list[str]) -> np.ndarray:  # pragma: no cover - interface
        raise NotImplementedError

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        enc = self

        @F.pandas_udf(S.VECTOR)
        def _udf(texts: pd.Series) -> pd.Series:
            out = []
            vals = texts.tolist()
            for i in range(0, len(vals), enc.batch_size):
                chunk = ["" if t is None else t for t in vals[i:i + enc.batch_size]]
                m = enc.encode(chunk).astype(np.float32)
                out.extend(list(m))
            res = pd.Series(out, index=texts.index, dtype=object)
            res[texts.isna()] = None
            return res

        return df.withColumn(out_col, _udf(F.col(text_col)))


class HashEmbedder(Embedder):
    """Token counts, signed and dealt into ``dim`` places by md5: the first 8
    hex digits choose the place, the next one the sign (8 to f: minus)."""

    name = "hash-384"
    batch_size = 8192
    #: Characters tokenised at a time, and tokens whose place is remembered.
    CHUNK, REMEMBERED = 2_000_000, 500_000

    def __init__(self, dim: int = S.EMBED_DIM):
        self.dim = dim
        self._places: dict[str, int] = {}

    def _place(self, token: str) -> int:
        h = hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()
        return int(h[:8], 16) % self.dim + (self.dim if h[8] >= "8" else 0)

    def _places_of(self, tokens) -> np.ndarray:
        known = self._places
        if len(known) > self.REMEMBERED:
            known.clear()
        out = np.empty(len(tokens), dtype=np.int64)
        for i, t in enumerate(tokens):
            p = known.get(t)
            if p is None:
                p = known[t] = self._place(t)
            out[i] = p
        return out

    def _counts(self, texts: list[str]) -> np.ndarray:
        """(texts x dim) signed counts: all tokens as one flat list, each
        distinct one hashed once, one count over (text, place)."""
        found = [_TOKEN.findall(t.lower()) for t in texts]
        flat = np.array(list(chain.from_iterable(found)), dtype=object)
        if not len(flat):
            return np.zeros((len(texts), self.dim))
        code, tokens = pd.factorize(flat)
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        wide = 2 * self.dim
        n = np.bincount(row * wide + self._places_of(tokens)[code], minlength=len(texts) * wide).reshape(len(texts), wide)
        return (n[:, :self.dim] - n[:, self.dim:]).astype(np.float64)

    def encode(self, texts: list[str]) -> np.ndarray:
        m, at = np.zeros((len(texts), self.dim)), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= self.CHUNK):
                size += len(texts[to])
                to += 1
            m[at:to] = self._counts(texts[at:to])
            at = to
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        np.divide(m, n, out=m, where=n > 0)
        return m


def reembed(memories: DataFrame, embedder: Embedder, as_of):
    """M7: every active note gets a new vector of ``title\\ncontent`` and
    ``updated_at`` = as_of; one ``reembed`` audit row each with the model
    name. Returns (new state, audit)."""
    from cairn.functions import text as X
    from cairn.operators import maintain as M
    ts = F.lit(as_of).cast(S.TS) if not hasattr(as_of, "_jc") else as_of
    act = F.col("status") == S.ACTIVE
    e = embedder.embed(memories.withColumn("_t", F.when(act, X.embedding_text("title", "content"))), "_t", "_v")
    state = (e.withColumn("embedding", F.when(act, F.col("_v")).otherwise(F.col("embedding")))
             .withColumn("updated_at", F.when(act, ts).otherwise(F.col("updated_at")))
             .drop("_t", "_v"))
    touched = memories.filter(act).withColumn("op_seq", F.lit(0).cast("long"))
    trail = M.audit(touched, "id", "reembed", M.json_obj(F.lit(embedder.name).alias("model")), as_of)
    return state, trail


def reembed_for_model(memories: DataFrame, old_model: str, embedder: Embedder, as_of):
    """Switching to the model already in use is a no-op; otherwise the
    impact (A5) and the re-embedded state (M7). Returns (impact, state,
    audit); state and audit are None for a no-op."""
    from cairn.operators import maintain as M
    if old_model == embedder.name:
        return None, None, None
    impact = M.reembed_impact(memories)
    state, trail = reembed(memories, embedder, as_of)
    return impact, state, trail
