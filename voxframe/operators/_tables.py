"""Tables that are computed once and read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """``df`` written in the folder of spark.checkpoint.dir, which all executors share, and cut off from what it was made of; in a
    local session that names no folder, in one of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets this session hand rows to Python in batches of at most ``most`` bytes (or of one row that is longer)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
