"""Where a model that makes vectors is plugged in: its forward pass is not part of this library."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    """A model: what its vectors are called, how long they are, and how they are made of 16 kHz mono samples.

    It must be picklable; weights are best loaded at the first call, once a worker.
    """

    model_id: str
    dim: int

    def extract(self, samples: np.ndarray) -> np.ndarray: ...


def embedded(df: DataFrame, samples: str, embedder: Embedder) -> DataFrame:
    """``df`` without ``samples`` (an array of floats) and with ``model_id`` and ``embedding``; null where samples are null or empty.

    A vector of another length than ``dim`` is an error; one with NaN stays, as later steps leave it out.
    """
    others = [c for c in df.columns if c != samples]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for x in batch.column(samples).to_pylist():
                v = None if not x else np.asarray(embedder.extract(np.asarray(x, np.float32)), float)
                if v is not None and v.shape != (embedder.dim,):
                    raise ValueError(f"{embedder.model_id} gave {v.shape}, not ({embedder.dim},)")
                vectors.append(None if v is None else v.tolist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array([embedder.model_id] * len(vectors), pa.string()), pa.array(vectors, pa.list_(pa.float64()))], names=[*others, "model_id", "embedding"]
            )

    types = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in others) + ", model_id string, embedding array<double>")
