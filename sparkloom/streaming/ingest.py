"""Resumable ingest: streams into deduplicating sinks, page checks, work queues and adaptive discovery."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.dedup import keep_first
from sparkloom.sources.tables import shared_dir


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of Parquet files with the schema that they have now."""
    folder, _, name = path.rpartition("/")
    # as a pattern, so that one file does as well as a folder of files
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/[{name[0]}]{name[1:]}")


class Sink:
    """A Parquet table to which each batch adds the rows whose keys it doesn't hold.

    The table itself is the state: a new Sink on the same path knows all batches that were written to an end, and a batch that is
    replayed under its own number, because its offset wasn't committed, replaces what it wrote before.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: str, path: str | None = None) -> None:
        self.spark, self.keys, self.order = spark, keys, order
        self.path = path or f"{shared_dir(spark)}/sparkloom/sink-{uuid.uuid4().hex}"

    def written(self) -> list[str]:
        """Folders of the batches that were written to an end, as the store has them now."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(conf)
        if not store.exists(root):
            return []
        names = [f.getPath().getName() for f in store.listStatus(root) if f.isDirectory()]
        return [f"{self.path}/{n}" for n in sorted(names) if store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def read(self, schema, but: str | None = None) -> DataFrame:
        there = [w for w in self.written() if w != but]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def add(self, batch: DataFrame, name: str) -> None:
        where = f"{self.path}/{name}"
        first = keep_first(batch, self.keys, self.order)
        first.join(self.read(batch.schema, where).select(*self.keys), self.keys, "left_anti").write.mode("overwrite").parquet(where)


def deduplicated(stream: DataFrame, keys: list[str], order: str, runs: int = 1) -> DataFrame:
    """First-wins rows of everything the stream has now; with several runs, each reads it from the start into the same sink."""
    sink = Sink(stream.sparkSession, keys, order)
    for run in range(runs):

        def batch(df: DataFrame, number: int, run=run) -> None:
            sink.add(df, f"run{run}-batch{number}")

        where = f"{shared_dir(stream.sparkSession)}/sparkloom/offsets-{uuid.uuid4().hex}"
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", where).trigger(availableNow=True).start()
        query.awaitTermination()
    return sink.read(stream.schema)


def bounded_dedup(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Deduplication whose state is dropped once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def repeated_pages(rows: DataFrame, job: str, page: str, item: str) -> DataFrame:
    """job, page, repeated: whether a page's set of items equals that of the page before of the same job."""
    sets = rows.groupBy(job, page).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(item)), "\n"), 256).alias("fp"))
    before = F.lag("fp").over(Window.partitionBy(job).orderBy(page))
    return sets.select(job, page, F.coalesce(before == F.col("fp"), F.lit(False)).cast("int").alias("repeated"))


def work_queue(events: DataFrame, bucket: str, job: str, action: str, order: str) -> DataFrame:
    """bucket, job, state, place: queues after a log of add, finish (to the tail), complete, remove and refresh events.

    A job's state depends on its own last events and the bucket's last refresh only, so no event is replayed one by one.
    """
    refresh = events.where(F.col(action) == "refresh").groupBy(bucket).agg(F.max(order).alias("__refresh"))
    own = events.where(F.col(action) != "refresh").groupBy(bucket, job).agg(
        F.max(F.when(F.col(action).isin("finish", "complete", "remove"), F.struct(F.col(order), F.col(action).alias("a")))).alias("__end"),
        F.max(F.when(F.col(action) == "add", F.col(order))).alias("__add"),
        F.min(F.when(F.col(action) == "add", F.col(order))).alias("__first"),
    )
    at = own.join(refresh, bucket, "left")
    end = F.col(f"__end.{order}")
    state = (
        F.when(F.col("__end").isNull() | (F.col("__end.a") == "finish"), "queued")
        .when((F.col("__end.a") == "complete") & (F.col("__refresh") > end), "queued")
        .when((F.col("__end.a") == "remove") & (F.col("__add") > end), "queued")
        .otherwise(F.when(F.col("__end.a") == "complete", "complete").otherwise("removed"))
    )
    since = F.when(F.col("__end").isNull(), F.col("__first")).when(F.col("__end.a") == "remove", F.col("__add")).when((F.col("__end.a") == "complete"), F.col("__refresh")).otherwise(end)
    out = at.withColumn("state", state).withColumn("__since", since)
    place = F.when(F.col("state") == "queued", F.row_number().over(Window.partitionBy(bucket, "state").orderBy("__since", job)))
    return out.withColumn("place", place).select(bucket, job, "state", "place")


def discovered(samples: DataFrame, item: str, stratum: str, least: int, strata: int) -> DataFrame:
    """item, samples, strata: items sampled often enough in enough strata become new searches."""
    per = samples.groupBy(item).agg(F.count("*").alias("samples"), F.count_distinct(stratum).alias("strata"))
    return per.where((F.col("samples") >= least) & (F.col("strata") >= strata))
