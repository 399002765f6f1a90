"""Tables in hash buckets: changes rewrite only the buckets that have a changed key.

Each bucket is a folder of Parquet files sorted by key. A change reads the buckets of its keys, writes what they
become to a table of its own and then swaps those folders in, as Spark's dynamic overwrite does when the job commits; the
files of other buckets stay as they are. Lookups by key read the buckets of the asked keys alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .staging import dropped, written

BUCKET = "_bucket"


@dataclass(frozen=True)
class Buckets:
    """A table at `path`, a folder that driver and executors share, by the hash of `keys` in `n` buckets.

    split: columns whose hash deals a bucket's rows to `parts` tasks and files, where one key may have very many rows.
    """

    path: str
    keys: tuple[str, ...]
    n: int = 64
    split: tuple[str, ...] = ()
    parts: int = 8

    def of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def create(self, df: DataFrame) -> None:
        """Writes all buckets anew. The layout is kept beside them, so no one opens the table with another one."""
        self._write(df.withColumn(BUCKET, self.of()), "static")
        layout = df.sparkSession.createDataFrame([(list(self.keys), self.n, df.schema.json())], "keys array<string>, n int, schema string")
        layout.coalesce(1).write.mode("overwrite").json(f"{self.path}/_layout")

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = [F.pmod(F.xxhash64(*self.split), F.lit(self.parts))] if self.split else []
        parted = rows.repartition(BUCKET, *dealt).sortWithinPartitions(BUCKET, *self.keys)
        parted.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd").partitionBy(BUCKET).parquet(self.path)

    def _read(self, spark: SparkSession) -> DataFrame:
        layout = spark.read.schema("keys array<string>, n int, schema string").json(f"{self.path}/_layout").first()
        if (tuple(layout["keys"]), layout["n"]) != (self.keys, self.n):
            raise ValueError(f"the table has {layout['n']} buckets by {', '.join(layout['keys'])}")
        schema = StructType.fromJson(json.loads(layout["schema"]))
        return spark.read.schema(StructType(list(schema.fields)).add(BUCKET, IntegerType())).parquet(self.path)

    def table(self, spark: SparkSession) -> DataFrame:
        return self._read(spark).drop(BUCKET)

    def some(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        """The rows of some buckets; no other folder is read."""
        return self._read(spark).where(F.col(BUCKET).isin(numbers)).drop(BUCKET)

    def numbers(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys: n numbers at most, whatever the number of rows."""
        return [r[0] for r in rows.select(self.of().alias("b")).distinct().collect()]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The table's rows whose key is among those of `keys`."""
        known = keys.select(*self.keys).distinct()
        return self.some(keys.sparkSession, self.numbers(known)).join(known, list(self.keys), "left_semi")

    def _swap(self, become: DataFrame, numbers: list[int]) -> None:
        """Puts these rows in the place of those of some buckets; a bucket of which nothing is left gets no rows."""
        spark = become.sparkSession
        staged = written(become.withColumn(BUCKET, self.of()), "buckets")
        self._write(staged, "dynamic")
        have = {r[0] for r in staged.select(BUCKET).distinct().collect()}  # n numbers at most
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for gone in set(numbers) - have:
            folder = hadoop(f"{self.path}/{BUCKET}={gone}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        dropped(staged)

    def upsert(self, new: DataFrame) -> list[int]:
        """New rows replace old ones of the same key, others are added; gives the buckets that were rewritten.

        New rows must have the table's columns and one row for each key. Columns that are null in a new row become null.
        """
        spark, new = new.sparkSession, written(new, "changes")
        numbers = self.numbers(new)
        if numbers:
            old = self.some(spark, numbers)
            self._swap(old.join(new.select(*self.keys), list(self.keys), "left_anti").unionByName(new.select(*old.columns)), numbers)
        dropped(new)
        return numbers

    def update(self, new: DataFrame, columns: list[str]) -> list[int]:
        """Columns of known keys take the new value where there is one; keys that the table doesn't have are left out."""
        spark, new = new.sparkSession, written(new.select(*self.keys, *(F.col(c).alias(f"_new_{c}") for c in columns)), "changes")
        numbers = self.numbers(new)
        if numbers:
            old = self.some(spark, numbers)
            both = old.join(new, list(self.keys), "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns})
            self._swap(both.select(*old.columns), numbers)
        dropped(new)
        return numbers

    def delete(self, keys: DataFrame) -> list[int]:
        """Rows of these keys go."""
        spark, keys = keys.sparkSession, written(keys.select(*self.keys).distinct(), "changes")
        numbers = self.numbers(keys)
        if numbers:
            self._swap(self.some(spark, numbers).join(keys, list(self.keys), "left_anti"), numbers)
        dropped(keys)
        return numbers

    def replace(self, gone: DataFrame, come: DataFrame, by: list[str]) -> list[int]:
        """Of the buckets of all these rows' keys: rows that agree with `gone` in the columns `by` go, those of `come` are added."""
        spark = come.sparkSession
        gone, come = written(gone.select(*dict.fromkeys([*self.keys, *by])).distinct(), "gone"), written(come, "come")
        numbers = sorted({*self.numbers(gone), *self.numbers(come)})
        if numbers:
            old = self.some(spark, numbers)
            self._swap(old.join(gone.select(*by).distinct(), by, "left_anti").unionByName(come.select(*old.columns)), numbers)
        dropped(gone, come)
        return numbers
