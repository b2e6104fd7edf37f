"""Embedders by name: what turns rows(id, normal) into vectors(id, buckets, weights), and a slot for a model of the caller's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import features
from .retrieval import DIM, TfidfIndex


class Embedder(Protocol):
    """signature tells embedders apart whose vectors don't belong together."""
    signature: str

    def embed(self, rows: DataFrame) -> DataFrame: ...


@dataclass
class Hashing:
    dim: int = 512

    @property
    def signature(self) -> str:
        return f"Hashing::{self.dim}"

    def embed(self, rows: DataFrame) -> DataFrame:
        return features.hashing_vectors(rows, self.dim)


@dataclass
class Tfidf:
    """Weights by an index's document frequencies; fit() writes one where none is given."""
    dim: int = DIM
    index: TfidfIndex | None = None

    @property
    def signature(self) -> str:
        return f"Tfidf::{self.dim}" if self.index is None else self.index.signature

    def fit(self, rows: DataFrame, path: str) -> Tfidf:
        if self.index is None:
            self.index = TfidfIndex.build(rows, path, self.dim)
        return self

    def embed(self, rows: DataFrame) -> DataFrame:
        if self.index is None:
            raise ValueError("fit the embedder first")
        return self.index.embed(rows)


@dataclass
class Model:
    """Dense vectors of a caller's function of a batch of texts, called within Arrow batches; no model comes with the library."""
    name: str
    encode: Callable[[list[str]], np.ndarray]
    dim: int

    @property
    def signature(self) -> str:
        return f"Model:{self.name}:{self.dim}"

    def embed(self, rows: DataFrame) -> DataFrame:
        encode, places = self.encode, list(range(self.dim))

        def run(batches):
            for b in batches:
                found = np.asarray(encode(b["normal"].tolist()), np.float64).reshape(len(b), len(places))
                length = np.linalg.norm(found, axis=1, keepdims=True)
                unit = np.divide(found, length, out=np.zeros_like(found), where=length > 0)
                yield pd.DataFrame({"id": b["id"], "buckets": [places] * len(b), "weights": list(unit)})

        return rows.select("id", "normal").mapInPandas(run, "id string, buckets array<int>, weights array<double>")


def embedder(spec: str, encode: Callable[[list[str]], np.ndarray] | None = None, dim: int | None = None) -> Embedder:
    """`hashing`, `tfidf`, or `model:<name>` with an encode function and its dimension. Other names are refused."""
    kind, _, name = spec.strip().partition(":")
    if kind == "model" and name and encode is not None and dim:
        return Model(name, encode, dim)
    if spec.strip() not in ("hashing", "tfidf"):
        raise ValueError(f"no embedder {spec!r}: hashing, tfidf, or model:<name> with encode and dim")
    return (Hashing if kind == "hashing" else Tfidf)(**({"dim": dim} if dim else {}))
