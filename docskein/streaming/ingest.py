"""Streams: incremental ingestion of chunks and load over call events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docskein.session import stage


def ingest_new(source: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of a stream whose key the target table doesn't have yet, each key once.

    Resumes at the checkpoint; a batch that is repeated after a failure adds nothing, as its keys are there by then.
    """

    def append(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(target)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            new = stage(new.join(spark.read.parquet(target).select(key), key, "left_anti"), "ingest")
        new.write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_load(events: DataFrame, at: str, name: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and mean value of each window and name; rows later than the watermark no longer count on a stream."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, window).alias("w"), name).agg(F.count("*").alias("calls"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), name, "calls", "mean")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: activity without a gap."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("events")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there now into an in-memory table, for tests."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema of what is there; path may also name one file, by its suffix."""
    folder, _, name = path.rstrip("/").rpartition("/")
    one = name.endswith(".parquet")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name if one else "*.parquet").parquet(folder if one else path)
