"""Streaming ingest of request logs into event tables and live aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.access import audit
from tessera.operators.layers import resolve_layers, with_policy
from tessera.operators.usage import extra_number
from tessera.sources.catalog import Layer
from tessera.sources.events import to_tile_events

# Batch size and age of the event pipeline.
MAX_SIZE = 1000
MAX_AGE = "10 seconds"
REFRESH = "2 seconds"


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000, pattern: str | None = None
) -> DataFrame:
    """Parquet files as a stream; the file limit is the backpressure."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def trigger_of(age: str, available_now: bool) -> dict:
    return {"availableNow": True} if available_now else {"processingTime": age}


def ingest_events(
    requests: DataFrame,
    layers: Iterable[Layer],
    target: str,
    checkpoint: str,
    max_size: int = MAX_SIZE,
    max_age: str = MAX_AGE,
    available_now: bool = False,
) -> StreamingQuery:
    """Request stream to an event table.

    A flush happens every ``max_age`` and files hold at most ``max_size`` events.
    The file sink's commit log makes each event appear once after a restart.
    """
    return (
        to_tile_events(requests, layers)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", max_size)
        .outputMode("append")
        .trigger(**trigger_of(max_age, available_now))
        .start()
    )


def live_counts(events: DataFrame) -> DataFrame:
    """Running sums per layer and zoom: the one streaming state of the dashboard."""
    ms = extra_number("duration")
    return events.groupBy("layer", "z").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.sum(ms).alias("ms_sum"),
        F.count(ms).alias("ms_n"),
        F.sum(extra_number("bytes")).alias("bytes"),
        F.max("time").alias("last_seen"),
    )


def dashboard_views(counts: DataFrame) -> dict[str, DataFrame]:
    """totals, by_layer and by_zoom out of ``live_counts`` rows (few: layers x zooms)."""
    average = F.round(
        F.coalesce(F.sum("ms_sum") / F.nullif(F.sum("ms_n"), F.lit(0)), F.lit(0.0))
    ).cast("int")
    return {
        "totals": counts.agg(
            F.coalesce(F.sum("tiles"), F.lit(0)).cast("bigint").alias("tiles"),
            F.count_distinct("layer").alias("layers"),
            average.alias("avg_duration_ms"),
            F.round(F.coalesce(F.sum("bytes"), F.lit(0.0))).cast("bigint").alias("total_bytes"),
        ),
        "by_layer": counts.groupBy("layer").agg(
            F.sum("tiles").alias("tiles"),
            F.max("last_seen").alias("last_seen"),
            average.alias("avg_duration_ms"),
        ),
        "by_zoom": counts.groupBy("z").agg(F.sum("tiles").alias("tiles")),
    }


def live_dashboard(
    events: DataFrame, target: str, checkpoint: str, refresh: str = REFRESH, available_now: bool = False
) -> StreamingQuery:
    """Keep the dashboard views current under ``target/<view>``.

    A view has two slots that are replaced in turn, so readers of the newer one are not disturbed and
    the number of folders does not grow.
    """

    def publish(counts: DataFrame, batch_id: int) -> None:
        counts.persist()
        try:
            for name, view in dashboard_views(counts).items():
                view.withColumn("batch_id", F.lit(batch_id).cast("long")).coalesce(1).write.mode("overwrite").parquet(
                    f"{target}/{name}/slot={batch_id % 2}"
                )
        finally:
            counts.unpersist()

    return (
        live_counts(events)
        .writeStream.foreachBatch(publish)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(refresh, available_now))
        .start()
    )


def read_view(spark: SparkSession, target: str, name: str) -> DataFrame:
    """Latest published state of one dashboard view."""
    views = spark.read.parquet(f"{target}/{name}")
    latest = views.agg(F.max("batch_id").alias("batch_id"))
    return views.join(latest, "batch_id", "left_semi").drop("batch_id", "slot")


def windowed_usage(events: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling usage per layer and zoom over event time, with a watermark for late rows."""
    timed = events.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", lateness)
    return (
        timed.groupBy(F.window("time", window).alias("w"), "layer", "z")
        .agg(
            F.count(F.lit(1)).alias("tiles"),
            F.sum(extra_number("bytes")).cast("bigint").alias("bytes"),
        )
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "layer", "z", "tiles", "bytes",
        )
    )


def append_stream(
    df: DataFrame, target: str, checkpoint: str, every: str = MAX_AGE, available_now: bool = False
) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger_of(every, available_now))
        .start()
    )


def enrich(requests: DataFrame, layers: Sequence[Layer], grants: DataFrame) -> DataFrame:
    """Layer, permission verdict and response policy on each request of a stream."""
    return with_policy(audit(resolve_layers(requests, layers), grants), layers)


def record_with(
    events: DataFrame,
    recorder: Callable[[DataFrame, Mapping, int], None],
    params: Mapping,
    checkpoint: str,
    every: str = MAX_AGE,
    available_now: bool = False,
) -> StreamingQuery:
    """Hand each micro-batch, the parameters and the batch's number to a user's recorder.

    A batch may come again after a failure, with the same number; a recorder that writes by number,
    replacing what is there, counts it once.
    """
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: recorder(batch, params, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(every, available_now))
        .start()
    )
