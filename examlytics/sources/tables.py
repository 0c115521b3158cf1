"""Scans of the landed driver tables (A5).

Plain ``spark.read.parquet``; Catalyst prunes columns and pushes filters into
the scan, so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition on ``key`` into ``spark.examlytics.scan.partitions`` partitions, if that is set.

    Unset (the default, and the right choice for tables of many files) the scan
    is used as it is. The local bench sets it, because its tables are one
    unsplittable file each.
    """
    want = df.sparkSession.conf.get("spark.examlytics.scan.partitions", None)
    return df.repartition(int(want), key) if want else df
