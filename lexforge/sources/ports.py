"""Ports to models: embeddings and chat, called from Arrow batches with bounded requests and retries."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Texts of one request, tries and first wait of a failing one.
REQUEST_TEXTS, TRIES, WAIT_S = 10, 3, 0.5


class ProviderError(RuntimeError):
    """A provider's failure; retryable ones (busy, timeouts, transport) are tried again."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


def retried(call: Callable, *args, tries: int = TRIES, wait: float = WAIT_S):
    """call(*args), again after growing waits where it fails with a retryable error."""
    for i in range(tries):
        try:
            return call(*args)
        except ProviderError as error:
            if not error.retryable or i == tries - 1:
                raise
            time.sleep(wait * 2**i)


def hashed_vectors(texts: list[str], dimension: int = 32) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: signed hashes of the words, of unit length."""
    out = np.zeros((len(texts), dimension))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[i, h % dimension] += 1 if h >> 63 else -1
    return (out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))).tolist()


def ordered_vectors(reply: list[dict], n: int) -> list[list[float]]:
    """Vectors of a reply's items (index, embedding) in the order of the index; all indexes once, one dimension."""
    by_index = {item["index"]: item["embedding"] for item in reply}
    if sorted(by_index) != list(range(n)) or len(reply) != n:
        raise ProviderError("the reply does not hold each text once")
    if len({len(v) for v in by_index.values()}) > 1:
        raise ProviderError("vectors of different length")
    return [by_index[i] for i in range(n)]


def embedded(rows: DataFrame, column: str, embed: Callable[[list[str]], list[list[float]]] = hashed_vectors, texts: int = REQUEST_TEXTS) -> DataFrame:
    """rows with an embedding column from requests of at most texts texts; rows stay in their partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[column].fillna("").tolist()
            vectors = [v for i in range(0, len(values), texts) for v in retried(embed, values[i : i + texts])]
            yield batch.assign(embedding=pd.Series(vectors, index=batch.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "embedding")
    return rows.drop("embedding").mapInPandas(run, f"{fields}, embedding array<float>")


def generated(rows: DataFrame, messages: str, generate: Callable[[list[dict]], str]) -> DataFrame:
    """rows with the model's answer, or an error instead of it: a case's failure stays its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for value in batch[messages]:
                try:
                    text = retried(generate, [m.asDict() if hasattr(m, "asDict") else dict(m) for m in value]).strip()
                    answers.append(text or None)
                    errors.append(None if text else "empty_response")
                except ProviderError as error:
                    answers.append(None)
                    errors.append(str(error))
            yield batch.drop(columns=[messages]).assign(answer=answers, error_code=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != messages)
    return rows.mapInPandas(run, f"{fields}, answer string, error_code string")
