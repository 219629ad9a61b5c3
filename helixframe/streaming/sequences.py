"""Structured Streaming over folders of sequence files and event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.operators import seeds


def lines(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """string_id (a hash), seq: one sequence a line of the text files that arrive in a folder; blank lines are skipped."""
    s = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return s.filter("trim(value) != ''").select(F.xxhash64("value").alias("string_id"), F.col("value").alias("seq"))


def tables(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def qgram_counts(strings: DataFrame, q: int, interval: int = 1) -> DataFrame:
    """gram, n: running counts (output mode update or complete)."""
    return seeds.qgrams(strings, q, interval).groupBy("gram").agg(F.count("*").alias("n"))


def best_so_far(scores: DataFrame) -> DataFrame:
    """read_id, score, ref_id: each read's best score over all batches (of equals, the largest ref_id)."""
    return scores.groupBy("read_id").agg(F.max(F.struct("score", "ref_id")).alias("_b")).select("read_id", "_b.score", "_b.ref_id")


def windowed(events: DataFrame, size: str, slide: str | None, late: str) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; rows later than ``late`` are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def map_batches(reads: DataFrame, mapper: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str):
    """A query that maps each batch of reads with a static mapper and writes its rows as Parquet, once a batch."""

    def batch(df: DataFrame, number: int) -> None:
        mapper(df).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


#: State of running results lies in files beside the executors, not in their heaps; each executor holds so much of it in memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # a lookup less for each key
}


def result(rows: DataFrame, folder: str) -> DataFrame:
    """The whole result of a running aggregate over all files that are there now.

    Executors write it as a table in ``folder``, anew after each batch, so the driver holds none
    of its rows; the checkpoint lies there too.
    """
    spark, table = rows.sparkSession, f"{folder}/table"
    spark.createDataFrame([], rows.schema).write.parquet(table)  # what stays if no file is there

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(table)

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        q = rows.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return spark.read.parquet(table)
