"""Sinks as functions from tables to tables, and writes that replace or extend them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first new row of each key that the table doesn't have is added."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = new.withColumn("_n", first).where("_n = 1").drop("_n").join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def update_from(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns take the new value where there is one."""
    new = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    out = old.join(new, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    return out.select(*old.columns)


def deactivate_then_insert(flags: DataFrame, new: DataFrame, match: Column) -> DataFrame:
    """Active flags that match are switched off, then the new ones are added as active."""
    off = flags.withColumn("is_active", F.when(match, False).otherwise(F.col("is_active")))
    return off.unionByName(new.withColumn("is_active", F.lit(True)), allowMissingColumns=True)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str = "year") -> None:
    """Only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_snapshot(df: DataFrame, path: str) -> None:
    df.withColumn("taken_at", F.current_timestamp()).write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_report(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))
