"""Embeddings of chunks through a provider; the built-in one is an offline stand-in."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.runtime import ship

DIMENSION = 768

#: A provider is loaded once in each task and maps texts to vectors.
Provider = Callable[[], Callable[[list[str]], list[list[float]]]]


def hashing_provider(dimension: int = DIMENSION) -> Provider:
    """A stand-in for a sentence model: signed hashes of words, of unit length. Not a trained model."""

    def load():
        def vector(text: str) -> list[float]:
            out = [0.0] * dimension
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                out[h % dimension] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in out)) or 1.0
            return [x / norm for x in out]

        return lambda texts: [vector(t) for t in texts]

    return load


def sentence_provider(model: str, device: str = "cpu") -> Provider:
    """A sentence model by name or folder, through the sentence_transformers library where that is installed."""

    def load():
        from sentence_transformers import SentenceTransformer

        loaded = SentenceTransformer(model, device=device)
        return lambda texts: loaded.encode(texts, convert_to_numpy=True).tolist()

    return load


def embedded(chunks: DataFrame, provider: Provider, text: str = "chunk_text") -> DataFrame:
    """Chunks with their embedding, a batch of texts at a time."""
    ship(chunks.sparkSession)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = provider()
        for texts in batches:
            yield pd.Series(run([t or "" for t in texts]))

    return chunks.withColumn("embedding", embed(text))


def embed_query(query: str, provider: Provider) -> list[float]:
    return list(map(float, provider()([query])[0]))
