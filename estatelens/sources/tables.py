"""Readers for the parquet tables this engine runs on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """One parquet table of the driver's data set (``<sf_dir>/<name>.parquet``), with ``columns`` only if given."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if columns is not None:
        df = df.select(*columns)
    return df
