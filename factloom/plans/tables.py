"""Tables cut off from how they were made, so plans stay small over many stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tables-"))
    return _local[0]


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read from there."""
    path = f"{folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
