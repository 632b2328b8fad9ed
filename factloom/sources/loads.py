"""What a Go package loader found, as a table that any loader can write.

JSON lines or Parquet with one row per package that was loaded:

    {"package": "obs.test/night/dome", "errors": ["could not import x"], "imports": ["fmt"]}

``errors`` is empty where the package was loaded and type-checked; ``imports`` names the packages
that it imports and that were loaded with it. A row without a package is left out, missing lists
are empty, and rows of one package are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "package string, errors array<string>, imports array<string>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(package, errors, imports) from a file or folder."""
    rows = spark.read.schema(SCHEMA).parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(SCHEMA).json(path)
    return clean(rows)


def clean(rows: DataFrame) -> DataFrame:
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    return rows.where("package <> ''").groupBy("package").agg(whole("errors"), whole("imports"))
