"""Cutting lineage between bounded iterations, at files that every executor can read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder, made once and read again.

    A table that is read has a size, so that plans upon it broadcast what is small by themselves; a checkpointed plan
    has none, and hands its constraints on to the plans upon it, which multiply over a chain of joins until planning
    takes longer than the work.
    """
    spark = df.sparkSession
    folder = f"{_shared(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def kept(df: DataFrame) -> DataFrame:
    """df as checkpointed rows: for a large table that one search reads whole, over and over, in simple plans."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder that the driver and all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):  # a folder of one machine serves tests only
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


#: Rows of a cut table, at most, that are broadcast.
SMALL = 200_000


#: Rows that a task groups or sorts, where rows are dealt in parts for it.
PART_ROWS = 1_000_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """In how many parts so many rows are dealt: spark.sql.shuffle.partitions or more, of PART_ROWS at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def hinted(df: DataFrame) -> DataFrame:
    """df as a cut table, marked for broadcast if it's small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def publish(tables: dict[str, DataFrame], mark: str, path: str) -> None:
    """Write tables to a folder of their own and, last, one row that names it: readers see all of them or none, and
    the version before stays whole meanwhile. Older versions stay until clean() removes them."""
    spark = next(iter(tables.values())).sparkSession
    before, folder = published(spark, path), f"{path}/{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    row = spark.createDataFrame([(before[0] + 1 if before else 1, mark, folder)], "version long, mark string, folder string")
    row.coalesce(1).write.mode("append").parquet(f"{path}/versions")


def published(spark: SparkSession, path: str) -> tuple[int, str, str] | None:
    """(version, mark, folder) of the last version at a path, if there is one."""
    try:
        versions = spark.read.schema("version long, mark string, folder string").parquet(f"{path}/versions")
    except AnalysisException:  # nothing has been published there
        return None
    last = versions.agg(F.max(F.struct("version", "folder", "mark")).alias("v")).first()["v"]
    return (last["version"], last["mark"], last["folder"]) if last else None


def clean(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the tables of all versions at a path but the last `keep`, and return their folders. Readers of an older
    version lose it, so that `keep` should cover the longest of them. Folders that no version names, such as those of a
    write that goes on, stay."""
    if keep < 1:
        raise ValueError("the last version is always kept")
    if published(spark, path) is None:
        return []
    versions = spark.read.schema("version long, mark string, folder string").parquet(f"{path}/versions")
    older = versions.orderBy(F.desc("version"), F.desc("folder")).offset(keep).collect()  # a row for each publication
    paths = [spark._jvm.org.apache.hadoop.fs.Path(row["folder"]) for row in older]
    return [at.toString() for at in paths if at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)]
