"""All registered queries of the library itself."""

from __future__ import annotations

from . import queries_metrics, queries_sampling, queries_sources, queries_values

QUERIES = queries_values.QUERIES
ORACLE = queries_values.ORACLE
#: These modules add their queries when they are imported.
MODULES = [queries_values, queries_sampling, queries_metrics, queries_sources]


def flagship(spark, sf_dir):
    """Errors of a coarse level against the grid at the table's points, with the grid's histogram."""
    from pyspark.sql import functions as F

    from ..functions.values import to_object_space
    from ..operators import grids, metrics, sampling
    from .bindings import RES, dense, points, result

    full = dense(spark, sf_dir)
    small = [grids.mip_size(n, 1) for n in RES]
    coarse = grids.mipmap(full, RES, 1)
    at = points(spark, sf_dir)
    truth = sampling.sample(to_object_space(at, (0, 0, 0), (1, 1, 1), RES), full, RES, ["px", "py", "pz"])
    seen = sampling.sample(to_object_space(at, (0, 0, 0), (1, 1, 1), small), coarse, small, ["px", "py", "pz"])
    errors = metrics.array_stats(sampling.pair_prediction(truth, seen, ["px", "py", "pz"]))
    counts = grids.volume_histogram(full, 64).withColumnRenamed("n", "voxels")
    return result(counts.crossJoin(F.broadcast(errors)))
