"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it names none, a folder of this machine if Spark runs on it alone, else an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: With it, Spark deletes the shuffle files of a query when the query ends, not when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def settle(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` there and read it back: what follows reads its rows several times. ``free``: ``df`` itself is not run again, and its shuffle files go."""
    spark = df.sparkSession
    shared_folder(spark)
    if not free:
        return df.checkpoint()
    with _freeing(spark):
        return df.select("*").checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same, as Parquet, which takes less room than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    with _freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
