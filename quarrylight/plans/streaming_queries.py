"""Change-queue and event-time queries (the latter an extra), each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.plans import executor_queries
from quarrylight.sources import scratch
from quarrylight.sources.views import table, with_views
from quarrylight.streaming import cdc

_KINDS = ("upsert_full", "upsert_partial", "variables", "delete")


def _queue(events):
    kinds = F.array(*map(F.lit, _KINDS))
    return events.select(F.col("user_id").alias("object_id"), F.col("event_id").alias("id"), F.element_at(kinds, (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("change_class"), F.col("event_id").alias("changed"))


def cdc_stream_state(spark, d):
    schema = table(spark, d, "events").schema
    return cdc.run_once(spark, f"{d}/events.parquet", schema, _queue)


def cdc_stream_poison(spark, d):
    """The same items as `cdc_poison_items`, by a stream with state."""
    folder = scratch.shared(spark, "attempts")
    events = cdc.parquet_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    ended = F.pmod("event_id", F.lit(3)) == 0
    attempts = events.select(F.col("user_id").alias("id"), F.floor(F.col("event_id") / 200).alias("changed"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.when(ended, "end").otherwise("begin").alias("event"))
    cdc.follow_attempts(attempts, folder).awaitTermination()
    return cdc.deaths_table(spark, folder).read().where("poisoned").select("id", "changed", F.col("deaths").cast("long").alias("deaths"))


def events_tumbling_window(spark, d):
    return cdc.windowed_counts(table(spark, d, "events"), "1 day")


QUERIES = {"cdc_stream_state": cdc_stream_state, "cdc_stream_poison": cdc_stream_poison, "events_tumbling_window": events_tumbling_window}
ORACLES = {
    "cdc_stream_state": with_views("queue", "SELECT object_id, max(id) AS id, arg_max(change_class, changed) AS change_class, max(changed) AS changed FROM queue GROUP BY object_id"),
    "cdc_stream_poison": executor_queries.ORACLES["cdc_poison_items"],
    "events_tumbling_window": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
