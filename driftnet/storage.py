"""Where intermediate results are kept so that they outlive an executor."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    if (now := sc.getCheckpointDir()) is not None:
        return now
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="driftnet-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared checkpoint folder that no table has yet."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read it from there; unlike after ``settle``, columns can be read alone."""
    path = path or fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
