"""Tables with insert, update, delete, upsert: every change gives a new snapshot.

Parquet tables have no MERGE; a change is an anti-join or a ranking, and ``swap`` writes the new snapshot beside
the old one.  The snapshot with the greatest number that Spark has marked as whole counts, so readers always find one
and never see a half-written table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ConflictError(ValueError):
    """A key that must be new is there already."""


class MissingError(ValueError):
    """A key that must be there is missing."""


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row per key: the one with the greatest version; nulls count as least."""
    order = Window.partitionBy(*keys).orderBy(*(F.col(v).desc_nulls_last() for v in version))
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def conflicts(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Keys of the batch that the table has."""
    return batch.select(key).distinct().join(table.select(key).distinct(), key, "left_semi")


def insert(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    if not conflicts(table, batch, key).isEmpty():
        raise ConflictError(f"a {key} of the batch is in the table")
    return table.unionByName(batch)


def insert_new(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The table and those rows of the batch whose key is new."""
    return table.unionByName(batch.join(table.select(key).distinct(), key, "left_anti").select(*table.columns))


def update(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Replaces rows whole; raises if a key is missing."""
    if not batch.select(key).distinct().join(table.select(key).distinct(), key, "left_anti").isEmpty():
        raise MissingError(f"a {key} of the batch is not in the table")
    return upsert(table, batch, key)


def upsert(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return table.join(batch.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(batch.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Missing keys are silent."""
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def delete_where(table: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is null stay."""
    return table.where(~F.coalesce(predicate, F.lit(False)))


def get(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def _whole_snapshots(spark: SparkSession, root: str) -> list[str]:
    """The names of the snapshots under ``root`` whose job has ended, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().getParent().getName() for f in found or ())


def exists(spark: SparkSession, root: str) -> bool:
    return bool(_whole_snapshots(spark, root))


def swap(df: DataFrame, root: str) -> str:
    """Writes a snapshot under ``root``, which counts from the moment that it is whole; returns its path."""
    names = _whole_snapshots(df.sparkSession, root)
    number = int(names[-1].split("-")[1]) + 1 if names else 0
    path = f"{root}/snapshot-{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    names = _whole_snapshots(spark, root)
    if not names:
        raise MissingError(f"there is no store under {root}")
    return spark.read.parquet(f"{root}/{names[-1]}")
