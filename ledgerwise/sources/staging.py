"""Tables written to the folder that all executors share, so that lineage ends and no executor's disk is needed again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: a temporary one if all tasks run in this process, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that a task sorts or groups at once, where rows are dealt.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by the keys to as many tasks as its `rows` fill; as it is, if the tasks that run at once can hold them.

    Joins, groups and windows by these keys and others then need no other exchange, and what a task holds doesn't grow with the table.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


#: Lists of what is written while someone keeps account; the innermost one counts.
_ACCOUNTS: list[list[DataFrame]] = []


@contextmanager
def written_within() -> Iterator[list[DataFrame]]:
    """The tables that are written inside, for whoever drops them once nothing reads them any more."""
    _ACCOUNTS.append([])
    try:
        yield _ACCOUNTS[-1]
    finally:
        _ACCOUNTS.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _ACCOUNTS:
        _ACCOUNTS[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of written tables that no result needs any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
