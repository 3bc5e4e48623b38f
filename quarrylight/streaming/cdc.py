"""The change queue as a stream: micro-batches are coalesced into deltas of a keyed table, and attempts are followed by
state: the keyed table of the items' deaths.

A batch writes its own rows only (see `deltas`), and one that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.sources.scratch import shared
from quarrylight.streaming.deltas import DeltaTable

STATE = "object_id long, id long, change_class string, changed long"
DEATHS = "id long, changed long, seq long, deaths int, retry_at timestamp, poisoned boolean, at timestamp"
#: An item that died is tried again after so many seconds, twice as many each time, up to the most.
BACKOFF, BACKOFF_MOST = 60, 3600
DEATH_LIMIT = 2


def state_table(spark: SparkSession, folder: str) -> DeltaTable:
    """The last change of each object; deletions stay as marks."""
    return DeltaTable(spark, f"{folder}/state", STATE, ("object_id",), "changed")


def apply_stream(changes: DataFrame, folder: str, available_now: bool = True):
    """Starts the query that keeps `state_table` of the folder up to date; changes is a streaming DataFrame of queue rows."""
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # two changes of one number: the greater id is the later one
        last = batch.groupBy("object_id").agg(F.max_by(F.struct("id", "change_class", "changed"), F.struct("changed", "id")).alias("r"))
        state_table(spark, folder).apply(last.select("object_id", "r.*"), number)

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 seconds")).start()


def deaths_after(attempts: DataFrame, table: DeltaTable, limit: int = DEATH_LIMIT, forget: str = "7 days") -> DataFrame:
    """Deaths of each item (id, changed) that a batch of attempts (id, changed, seq, at, event: begin or end) touches.

    A begin without an end is a death; an end clears the item. Each row says when to try again (a longer wait after each
    death) and whether the item has died `limit` times. Attempts up to an item's last `seq` were seen before. Those that
    are `forget` of event time older than the latest of earlier batches are dropped, and an item of which nothing has
    been heard for so long before that starts anew.
    """
    rows = attempts.select("id", "changed", "seq", F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("event") == "end", F.lit(False)).alias("end"))
    held = table.held(rows.select("id", "changed"))
    wait = F.expr(f"interval {forget}")
    if "latest" in table.state:
        mark = F.timestamp_micros(F.lit(table.state["latest"])) - wait
        rows, held = rows.where(F.col("at") >= mark), held.where(F.col("at") + wait >= mark)
    held = held.select(F.col("id").alias("_id"), F.col("changed").alias("_changed"), F.col("seq").alias("_seen"), F.col("deaths").alias("_deaths"))
    new = rows.join(held, F.col("id").eqNullSafe(F.col("_id")) & F.col("changed").eqNullSafe(F.col("_changed")), "left").where(F.col("seq") > F.coalesce("_seen", F.lit(-1)))
    last = F.max(F.when(F.col("end"), F.col("seq"))).over(Window.partitionBy("id", "changed"))
    counted = F.count_if(~F.col("end") & (F.col("seq") > F.coalesce("_end", F.lit(-1)))) + F.when(F.max("_end").isNull(), F.coalesce(F.max("_deaths"), F.lit(0))).otherwise(0)
    items = new.withColumn("_end", last).groupBy("id", "changed").agg(F.max("seq").alias("seq"), counted.cast("int").alias("deaths"), F.max("at").alias("at"))
    longer = F.least(F.lit(BACKOFF_MOST), BACKOFF * F.pow(F.lit(2), F.least(F.col("deaths") - 1, F.lit(20))))
    retry = F.when(F.col("deaths") > 0, F.col("at") + F.make_dt_interval(secs=longer))
    return items.select("id", "changed", "seq", "deaths", retry.alias("retry_at"), (F.col("deaths") >= limit).alias("poisoned"), "at")


def deaths_table(spark: SparkSession, folder: str) -> DeltaTable:
    return DeltaTable(spark, f"{folder}/deaths", DEATHS, ("id", "changed"), "seq")


def follow_attempts(attempts: DataFrame, folder: str):
    """Starts the query that keeps `deaths_table` of the folder up to date; the table is also its state."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession  # the stream's own
        spark.conf.set("spark.sql.adaptive.enabled", "true")  # few files for a small batch
        table = deaths_table(spark, folder)
        if number <= table.state["last"]:
            return
        latest = [x for x in (batch.agg(F.max(F.unix_micros(F.col("at").cast("timestamp")))).first()[0], table.state.get("latest")) if x is not None]
        table.apply(deaths_after(batch, table), number, {"latest": max(latest)} if latest else {})

    return attempts.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_attempts").trigger(availableNow=True).start()


def parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of a parquet folder, or of a single file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def run_once(spark: SparkSession, path: str, schema, to_queue) -> DataFrame:
    """Streams what a parquet folder holds now through the merge, and returns the state."""
    folder = shared(spark, "cdc")
    apply_stream(to_queue(parquet_stream(spark, path, schema)), folder).awaitTermination()
    return state_table(spark, folder).read()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows of event time, batch or streaming; streams drop what is later than `late`."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    counts = stamped.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("string").alias("start"), "event_type", "n")
