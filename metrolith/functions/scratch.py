"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset and all
    tasks run in the driver's process (local tests) a temporary folder is made and
    remembered in the session; on a cluster it must be set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.metrolith.scratch", ""
    )
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="metrolith-")
        spark.conf.set("spark.metrolith.scratch", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/metrolith/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it was running, not
    the passes that led here, and expensive text passes run once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
