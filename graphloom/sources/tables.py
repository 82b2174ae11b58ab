"""Parquet tables of one directory, and the one rule for rows that were delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` stored as ``<directory>/<name>.parquet`` (a file or a directory of parts)."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def first_delivery(df: DataFrame, key: str, columns: list[str], order: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the values of its earliest delivery by ``order`` (null order last).

    ``min_by`` over a struct is a partial aggregate, so a key delivered very often is combined before the shuffle.
    Rows with a null key are dropped, as they can't be told apart.
    """
    values = F.struct(*[F.col(c).alias(c) for c in columns])
    rank = F.struct(F.col(order).isNull(), F.col(order), F.xxhash64(values))
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(values, rank).alias("__v"))
    return kept.select(key, *[F.col("__v")[c].alias(c) for c in columns])
