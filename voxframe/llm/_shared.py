"""Tables that are written once and read several times, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of its own only where that is unset, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets this session hand rows to Python in batches of at most ``most`` bytes (or of one row that is longer)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it is computed once, and no executor's loss undoes it.

    ``free``: lets the driver collect its garbage, upon which Spark removes the shuffle files of steps that are over. Otherwise
    they take disk until the driver happens to do so.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.folder = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``written`` returned and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem
