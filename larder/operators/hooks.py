"""Where callers plug in their own code: encoders and probes, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

#: Inputs that an encoder gets at once.
BATCH = 16


def embed(backlog: DataFrame, make: Callable[[], Callable[[list], list]], model: str, column: str = "input", batch: int = BATCH) -> DataFrame:
    """(asset_id, model, vector, error) of inputs (asset_id, column) by a caller's encoder, made once a worker.

    An input that fails, or gets no result, has a null vector and its error; it fails no other. If a batch fails as a
    whole its inputs are tried one by one. Vectors are stored at unit length.
    """
    kind = StructType([StructField("vector", ArrayType(FloatType())), StructField("error", StringType())])

    def one(encode: Callable, items: list) -> list[tuple]:
        try:
            found = list(encode(items))
            if len(found) != len(items):
                raise ValueError(f"{len(found)} results for {len(items)} inputs")
        except Exception as error:  # the caller's code may fail in any way
            if len(items) > 1:
                return [x for item in items for x in one(encode, [item])]
            return [(None, f"{type(error).__name__}: {error}")]
        out = []
        for v in found:
            size = None if v is None else float(np.linalg.norm(v))
            out.append((None, "no result") if v is None else ((np.asarray(v, np.float32) / (size or 1)).tolist(), None))
        return out

    @F.pandas_udf(kind)
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = make()
        for part in parts:
            rows = [x for k in range(0, len(part), batch) for x in one(encode, part.iloc[k : k + batch].tolist())]
            yield pd.DataFrame(rows, columns=["vector", "error"])

    return backlog.select("asset_id", apply(column).alias("x")).select("asset_id", F.lit(model).alias("model"), "x.vector", "x.error")


def probe(items: DataFrame, probes: dict[str, Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Facts of items (asset_id, kind, ...) by the caller's probe of each kind, with asset_id and error.

    A probe takes and returns a frame with a row for each item, index kept. If it fails, its items are tried one by
    one and those that fail have nulls and the error. Kinds without a probe have no rows.
    """
    full, out = f"asset_id long, {schema}, error string", None
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(fn: Callable) -> Callable:
        def attempt(frame: pd.DataFrame) -> pd.DataFrame:
            try:
                return fn(frame).reindex(columns=names).assign(asset_id=frame["asset_id"], error=None)
            except Exception as error:  # the caller's code may fail in any way
                if len(frame) > 1:
                    return pd.concat([attempt(frame.iloc[[k]]) for k in range(len(frame))])
                return pd.DataFrame([dict.fromkeys(names)]).assign(asset_id=frame["asset_id"].iloc[0], error=f"{type(error).__name__}: {error}")

        return lambda frames: (attempt(f)[["asset_id", *names, "error"]] for f in frames if len(f))

    for kind, fn in probes.items():
        part = items.where(F.col("kind") == kind).mapInPandas(run(fn), full)
        out = part if out is None else out.union(part)
    return out
