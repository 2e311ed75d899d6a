"""Encoders as a protocol: any object with a version and a batch function; applied to tables by Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Encoder(Protocol):
    dim: int
    version: int

    def encode(self, items: list) -> np.ndarray: ...


class HashEncoder:
    """A stand-in without any model: a fixed random vector for each item's words, summed. It knows no meaning."""

    def __init__(self, dim: int = 96, version: int = 1):
        self.dim, self.version = dim, version

    def encode(self, items: list) -> np.ndarray:
        out = np.zeros((len(items), self.dim), np.float32)
        for i, item in enumerate(items):
            for word in str(item).lower().split() if item is not None else ():
                seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i] += np.random.default_rng(seed).standard_normal(self.dim).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(rows: DataFrame, column: str, encoder: Encoder) -> DataFrame:
    """rows(id, column) as (id, vec, version); null items give a null vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(column).to_pylist()
            x = encoder.encode(items)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([None if i is None else v.tolist() for i, v in zip(items, x, strict=True)], pa.list_(pa.float32())), pa.array([encoder.version] * len(items), pa.int32())], names=["id", "vec", "version"])

    return rows.select("id", column).mapInArrow(run, "id bigint, vec array<float>, version int")


def cascade(first: np.ndarray, second, threshold: float = 1e-4) -> np.ndarray:
    """Scores of a cheap model, replaced by those of an expensive one where they aren't below the threshold.

    second(positions) gives the expensive scores of those rows, or None if that model is missing.
    """
    out, ask = first.copy(), np.flatnonzero(first >= threshold)
    if len(ask) and (better := second(ask)) is not None:
        out[ask] = better
    return out


def routes(text: str, has_english: bool, has_other: bool) -> str | None:
    """Which text encoder to use: the English one for Latin letters, else the multilingual; the other if it is missing."""
    from prismlake.functions.text import is_latin

    order = ("english", "multilingual") if is_latin(text) else ("multilingual", "english")
    there = {"english": has_english, "multilingual": has_other}
    return next((o for o in order if there[o]), None)
