"""Set operations on tables and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def queue_view(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """G1: all parts under one schema, missing columns null, with the part's name in ``queue``."""
    named = [df.withColumn("queue", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).select(*columns, "queue")


def covered(parts: list[DataFrame], key: str) -> DataFrame:
    """G2."""
    return reduce(DataFrame.union, (p.select(key) for p in parts)).distinct()


def only_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Null-safe in the sense that a null in ``second`` removes nothing."""
    return first.select(key).distinct().join(second.select(key), key, "left_anti")


def shared(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """G4."""
    return first.select(key).distinct().join(second.select(key), key, "left_semi")


def partition_check(df: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """Rows in several classes and rows in none."""
    hits = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(False)).cast("int") for c in classes.values()))
    return df.agg(F.count("*").alias("n"), F.count_if(hits > 1).alias("n_overlap"), F.count_if(hits == 0).alias("n_uncovered"))
