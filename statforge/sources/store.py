"""Cutting lineage by tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that ``spark.checkpoint.dir`` names.

    Where that is unset, a local session gets a folder of its own; a cluster
    has no folder that all its machines share but by that setting.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        at = tempfile.mkdtemp(prefix="statforge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/statforge-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its plan runs once, and a lost executor costs a reread.

    Results are lazy and may read the table until the end; ``cleared`` deletes all tables of the application.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Delete what ``written`` wrote in this application; results that aren't computed yet are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
