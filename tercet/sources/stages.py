"""Stage tables: frames that several steps read, written once into the cluster's shared folder and read again.

What follows a stage starts at a scan of its columns, not at the whole chain before it, and survives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one in the warehouse, or for a local master a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="tercet-") if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tercet-checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table of its own in the shared folder; the files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` to as many tasks as the session has shuffle partitions, for windows that compute much more
    than they read: adaptive execution would merge such partitions by their bytes.  Windows on the keys need no shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
