"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named table's columns; columns beyond these are never read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without that setting (as in tests) gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(path)
        return path
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing needs any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files that no DataFrame refers to any more: it acts when the driver's heap is collected."""
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small table."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def sums_before(df: DataFrame, value: str, group: str, place: str, cell: int = 4096) -> DataFrame:
    """df with ``before``: the sum of value over the group's smaller places.

    Sums of cells of places come first, then places within a cell, so no window holds more
    than a cell or a group's cells.
    """
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("cell", F.floor(F.col(place) / cell))
    cells = df.groupBy(group, "cell").agg(F.sum(value).alias("in_cell"))
    cells = cells.withColumn("base", F.coalesce(F.sum("in_cell").over(earlier.partitionBy(group).orderBy("cell")), F.lit(0))).drop("in_cell")
    inner = F.coalesce(F.sum(value).over(earlier.partitionBy(group, "cell").orderBy(place)), F.lit(0))
    return df.withColumn("inner", inner).join(cells, [group, "cell"]).withColumn("before", F.col("base") + F.col("inner")).drop("base", "inner", "cell")


def id_mod(col: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
