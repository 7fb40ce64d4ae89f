"""Batch scoring of stored models on points: the latent lookup stays a Spark join, dense layers are matrix products on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import fourier_features
from .grids import AXES
from .metrics import array_stats, l1_l2, psnr
from .sampling import interp_vectors, with_latent

ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "ReLU": lambda x: np.maximum(x, 0),
    "Sine": np.sin,
    "Sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "None": lambda x: x,
}
SOFTPLUS = lambda x: np.logaddexp(x, 0)


@dataclass
class Model:
    """Layers of (weights, bias); ``frequency`` for Snake; ``output``: density or rgbo, with "direct" or "exp" mappings."""

    layers: Sequence[tuple[np.ndarray, np.ndarray]]
    activation: str = "ReLU"
    frequency: float = 1.0
    output: str = "density"
    residual: bool = False

    def _active(self, x: np.ndarray) -> np.ndarray:
        f = self.frequency
        if self.activation == "Snake":
            return x + np.sin(f * x) ** 2 / f
        if self.activation == "SnakeAlt":
            return (x + 1 - np.cos(2 * f * x)) / (2 * f)
        return ACTIVATIONS[self.activation](x)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(self.layers):
            y = x @ np.asarray(w) + np.asarray(b)
            if k + 1 < len(self.layers):
                y = self._active(y)
                x = (x + y) / 2 if self.residual and y.shape == x.shape else y
            else:
                x = y
        if self.output == "density":
            return 1 / (1 + np.exp(-x))
        if self.output == "density:direct":
            return np.clip(x, 0, 1)
        colour = 1 / (1 + np.exp(-x[:, :3]))
        if self.output == "rgbo":
            return np.concatenate([colour, SOFTPLUS(x[:, 3:])], axis=1)
        if self.output == "rgbo:direct":
            return np.concatenate([np.clip(x[:, :3], 0, 1), np.maximum(x[:, 3:], 0)], axis=1)
        return np.concatenate([colour, np.exp(x[:, 3:])], axis=1)


def score(points: DataFrame, model: Model, inputs: Sequence[str], key: Sequence[str], outputs: Sequence[str] = ("value",)) -> DataFrame:
    """key and outputs of the model at each point; the model travels with the tasks. Inputs are numbers or arrays of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = []
            for c in inputs:
                column = batch.column(c)
                numbers = (column.flatten() if c in wide else column).to_numpy(zero_copy_only=False).astype(float)
                parts.append(numbers.reshape(batch.num_rows, -1))
            got = model(np.concatenate(parts, axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *(pa.array(v, pa.float64(), from_pandas=True) for v in got.T)], names=[*key, *outputs])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    wide = {c for c in inputs if kinds[c].startswith("array")}
    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), *(f"`{o}` double" for o in outputs)])
    return points.select(*key, *(c for c in inputs if c not in key)).mapInArrow(run, ddl)


def latent_inputs(points: DataFrame, key: Sequence[str], latent: DataFrame | None = None, res: Sequence[int] = (), vectors: DataFrame | None = None, count: int = 0, bands: int = 0, time_bands: int = 0, prefix: str = "f", time_grids: DataFrame | None = None, times: int = 0, ensemble_grids: DataFrame | None = None, members: int = 0) -> tuple[DataFrame, list[str]]:
    """``points`` (key, px, py, pz, and t and e, fractional indices, where they are used) with a network's inputs, and their names.

    In order: the position; ``bands`` Fourier bands of it and ``time_bands`` of t; the channels of a ``latent`` grid of size
    ``res`` at the position (channel, x, y, z, value); those of ``time_grids`` mixed at t and of ``ensemble_grids`` mixed at e (with frame);
    the entries of ``vectors`` (idx, channel, value), one for each of ``count`` times or members, mixed at t. Grids add an array to
    a point's own row; only vectors are joined back by key.
    """
    place = [f"p{a}" for a in AXES]
    out, names = points, list(place)
    for own, n, stem in ((place, bands, prefix), (["t"], time_bands, f"{prefix}_t")):
        if n:
            before = set(out.columns)
            out = fourier_features(out, own, n, stem)
            names += [c for c in out.columns if c not in before]
    for stem, grids, index, frames in (("l", latent, None, 0), ("lt", time_grids, "t", times), ("le", ensemble_grids, "e", members)):
        if grids is not None:
            out = with_latent(out, grids, res, f"{prefix}_{stem}", index, frames)
            names.append(f"{prefix}_{stem}")
    if vectors is not None:
        got = interp_vectors(points, vectors, count, key)
        listed = got.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("channel", "value"))).alias("c"))
        out = out.join(listed.select(*key, F.col("c.value").alias(f"{prefix}_v")), list(key))
        names.append(f"{prefix}_v")
    return out, names


def evaluate_model(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """l1, l2, psnr, rmse, ncc of predictions by group, e.g. time, ensemble, model."""
    a = l1_l2(pairs, by).drop("total")
    b = array_stats(pairs, by).select(*by, "n", "rmse", "ncc")
    c = psnr(pairs, by)
    if by:
        return a.join(b, list(by)).join(c, list(by))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))
