"""The seam for a model: batches of items in, vectors out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vectorloom.functions.cluster import ship


def is_memory(error: Exception) -> bool:
    """A batch was too large: Python's own error, or what device libraries say."""
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def embed(rows: DataFrame, key: str, item: str, load: Callable[[], Callable[[list], np.ndarray]], batch: int = 32, on_error: str = "null", dims: int | None = None) -> DataFrame:
    """``key``, v, error: the vector of each item, of unit length.

    ``load`` makes the model once for each task and must be picklable. A batch that fails for want of memory is
    halved; an item that is too large alone has a null vector, or ``dims`` zeros with on_error='zero', and its error. Any
    other fault of the model is raised.
    """
    if on_error not in ("null", "zero"):
        raise ValueError("on_error is null or zero")
    if on_error == "zero" and dims is None:
        raise ValueError("zeros need dims")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def vectors(items: list) -> list[tuple[np.ndarray | None, str | None]]:
            try:
                found = np.asarray(model(items), np.float64)
                return [(v / max(np.sqrt((v * v).sum()), 1e-12), None) for v in found]
            except Exception as error:
                if not is_memory(error):
                    raise
                if len(items) > 1:
                    half = len(items) // 2
                    return vectors(items[:half]) + vectors(items[half:])
                return [(np.zeros(dims) if on_error == "zero" else None, str(error)[:500])]

        for frame in frames:
            items, out = frame[item].tolist(), []
            for a in range(0, len(items), batch):
                out += vectors(items[a : a + batch])
            yield pd.DataFrame({key: frame[key], "v": [v for v, _ in out], "error": [e for _, e in out]})

    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    return rows.select(key, item).mapInPandas(run, f"`{key}` {kind}, v array<float>, error string")
