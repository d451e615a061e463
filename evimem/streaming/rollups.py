"""Structured Streaming jobs over ledgers: daily rollups, deliveries counted once, sessions. Batch and stream share their columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimem.session import shared_dir


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream over the files of a parquet table, which is one file or a folder of them; the schema is the table's."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if folder:
        return reader.parquet(path)
    parent, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(parent)


def daily_columns(rows: DataFrame, at: str, by: str, value: str) -> DataFrame:
    """Counts and sums by day and `by`: the same for a batch and for a stream with a watermark on `at`."""
    return rows.groupBy(F.window(at, "1 day"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.to_date("window.start").alias("day"), by, "n", "total")


def run_updates(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs a stream of updated rows over what is there, and gives the last state of each key.

    Each micro-batch writes its updates under its own number, so a batch that runs again after a failure replaces its files; state and
    progress lie in the shared folder.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    found = spark.read.schema(stream.withColumn("batch", F.lit(0)).schema).parquet(f"{base}/out/part=*")
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


def daily_rollup(spark: SparkSession, path: str, at: str, by: str, value: str, late: str = "30 days") -> DataFrame:
    """Daily counts and sums of a table read as a stream; rows later than `late` behind the latest are left to the batch job."""
    rows = file_stream(spark, path).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return run_updates(daily_columns(rows, at, by, value), ["day", by], "rollup")


def counted_once(spark: SparkSession, path: str, key: str, at: str, by: str, late: str = "30 days") -> DataFrame:
    """Rows by `by` of a stream in which deliveries of one `key` within `late` count once; rows without key or time do not count."""
    rows = file_stream(spark, path).withColumn(at, F.col(at).cast("timestamp")).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    once = rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return run_counts(once, by)


def run_counts(stream: DataFrame, by: str) -> DataFrame:
    """Counts of an append-only stream by one column, added up over its micro-batches."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/counts-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    run = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    found = spark.read.schema(f"{by} {dict(stream.dtypes)[by]}, n bigint").parquet(f"{base}/out/part=*")
    return found.groupBy(by).agg(F.sum("n").alias("n"))


def sessions(rows: DataFrame, by: str, at: str, gap: str = "6 hours") -> DataFrame:
    """Sessions of each key: events less than `gap` apart, with their number and span; for batch and stream alike."""
    timed = rows.where(F.col(by).isNotNull() & F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("timestamp"))
    return timed.groupBy(by, F.session_window("_at", gap)).agg(F.count("*").alias("events"), F.min("_at").alias("first"), F.max("_at").alias("last")).select(by, "events", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def unresolved(usage: DataFrame, as_of, hours: int = 12) -> DataFrame:
    """Pending rows older than `hours` whose task has a resolved outcome by now (resolvable) or none (stale)."""
    old = usage.where((F.col("outcome") == "pending") & (F.col("created_at") < as_of - F.expr(f"interval {hours} hours")))
    done = usage.where("outcome <> 'pending' and resolved_at is not null").groupBy("task_id").agg(F.max_by("outcome", F.struct("resolved_at", "usage_id")).alias("outcome_now"))
    return old.select("usage_id", "task_id", "memory_id").join(done, "task_id", "left").select("usage_id", "task_id", "memory_id", F.coalesce("outcome_now", F.lit("stale")).alias("outcome_now"))
