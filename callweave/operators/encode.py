"""Document vectors from any encoder, in batches."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sign patterns kept between batches of a task.
KNOWN_TERMS = 200_000

Encoder = Callable[[list[str]], np.ndarray]


def embed_documents(
    docs: DataFrame, encoder: Encoder, batch_size: int = 1000, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, embedding``: the encoder sees at most ``batch_size`` texts at a time, inside the tasks."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                vectors = np.asarray(encoder(part[text].tolist()), dtype=np.float32)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(vectors)})

    slim = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    return slim.mapInPandas(run, f"`{key}` {key_type}, embedding array<float>")


class HashedEncoder:
    """Signed random projection of the term counts, without any training.

    Every term owns a sign pattern read from the bits of its MD5 hash; a text is the sum over its
    terms, scaled to length one.
    """

    word = re.compile(r"\w{2,}")

    def __init__(self, dims: int = 64):
        if dims > 128:
            raise ValueError("an MD5 hash gives 128 signs")
        self.dims = dims
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, dims))

    def _row(self, term: str) -> int:
        at = self.known.get(term)
        if at is None:
            at = self.known[term] = len(self.known)
            if at == len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            bits = np.unpackbits(np.frombuffer(hashlib.md5(term.encode()).digest(), dtype=np.uint8))
            self.table[at] = bits[: self.dims] * 2.0 - 1.0
        return at

    def __call__(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN_TERMS:
            self.known.clear()
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            counts = Counter(self.word.findall(text.lower()))
            if counts:
                rows = np.array([self._row(t) for t in counts])
                out[i] = np.array(list(counts.values()), dtype=np.float64) @ self.table[rows]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1.0)
