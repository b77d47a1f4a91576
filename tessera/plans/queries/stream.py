"""Streaming queries: each runs a stream over the event table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.usage import delivery_counters
from tessera.plans.queries import logs, sql, store, usage
from tessera.session import shared_dir
from tessera.sources import derived as d
from tessera.sources.events import to_tile_events
from tessera.streaming import delivery, ingest, stateful

def request_stream(spark, sf):
    schema = d.table(spark, sf, "events").schema
    return d.requests_from_events(ingest.read_stream(spark, sf, schema, pattern="events.parquet"))


def event_stream(spark, sf):
    return to_tile_events(request_stream(spark, sf), d.LAYERS)


def finish(query):
    """Wait for an available-now stream to work off its input, however long that takes."""
    query.awaitTermination()


def stream_ingest(spark, sf):
    out = shared_dir(spark, "ingest")
    finish(
        ingest.ingest_events(
            request_stream(spark, sf), d.LAYERS, f"{out}/events", f"{out}/checkpoint", available_now=True
        )
    )
    events = spark.read.parquet(f"{out}/events")
    return events.select(
        "event_id", "time", "layer", "z", "x", "y", "user_id", F.col("extra")["bytes"].alias("bytes")
    )


def _dashboard(spark, sf, name):
    out = shared_dir(spark, "dashboard")
    finish(ingest.live_dashboard(event_stream(spark, sf), f"{out}/views", f"{out}/checkpoint", available_now=True))
    return ingest.read_view(spark, f"{out}/views", name)


def windowed_usage(spark, sf):
    out = shared_dir(spark, "windows")
    windows = ingest.windowed_usage(event_stream(spark, sf), "1 hour", "2 hours")
    finish(ingest.append_stream(windows, f"{out}/rows", f"{out}/checkpoint", available_now=True))
    rows = spark.read.parquet(f"{out}/rows")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def fetch_stream(spark, sf):
    out = shared_dir(spark, "fetches")
    rows = stateful.fetch_stream(request_stream(spark, sf), stateful.TTL_KEY_VALUE, buckets=stateful.BUCKETS)
    finish(ingest.append_stream(rows, f"{out}/rows", f"{out}/checkpoint", available_now=True))
    return spark.read.parquet(f"{out}/rows")


def change_alerts(spark, sf):
    out = shared_dir(spark, "alerts")
    i = F.col("request_id")
    key = F.concat_ws("/", "layer_name", "z", "x", "y")
    observed = request_stream(spark, sf).select(
        "layer_name", "z", "x", "y", F.col("time").alias("written_at"), i.alias("version"),
        F.concat(key, F.when(i % 7 == 0, F.lit("-old")).otherwise(F.lit(""))).cast("binary").alias("content"),
        "content_type",
    )
    rows = stateful.change_stream(observed)
    finish(ingest.append_stream(rows, f"{out}/rows", f"{out}/checkpoint", available_now=True))
    return spark.read.parquet(f"{out}/rows").select("layer_name", "z", "x", "y", "version", "content_type")


def enriched_stream(spark, sf):
    out = shared_dir(spark, "enriched")
    rows = ingest.enrich(request_stream(spark, sf), d.LAYERS, d.grants(spark)).select(
        "request_id", "layer_id", "verdict", F.col("policy.max_length").alias("max_length")
    )
    finish(ingest.append_stream(rows, f"{out}/rows", f"{out}/checkpoint", available_now=True))
    return spark.read.parquet(f"{out}/rows")


def _run_batches(spark, sf, deliver, out):
    finish(
        event_stream(spark, sf)
        .writeStream.foreachBatch(deliver)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def _refuse(batch, batch_id):
    raise ConnectionError("refused")


def contained_failures(spark, sf):
    """One sink fails; its batch lands in the dead letters and the stream ends well."""
    out = shared_dir(spark, "contained")
    _run_batches(spark, sf, delivery.contained(_refuse, "webhook", f"{out}/log", f"{out}/dead"), out)
    dead = spark.read.parquet(f"{out}/dead")
    return dead.groupBy("sink", "error").agg(F.count(F.lit(1)).alias("events"))


def sink_fan_out(spark, sf):
    """Two sinks take the same batches, a third fails; counters per sink."""
    out = shared_dir(spark, "fanout")

    def near(batch, batch_id):
        batch.select("event_id").write.mode("overwrite").parquet(f"{out}/near/batch_id={batch_id}")

    def far(batch, batch_id):
        batch.select("event_id", "layer").write.mode("overwrite").parquet(f"{out}/far/batch_id={batch_id}")

    sinks = {"near": near, "broken": _refuse, "far": far}
    _run_batches(spark, sf, delivery.fan_out(sinks, f"{out}/log", False, f"{out}/dead"), out)
    stored = spark.read.parquet(f"{out}/near").join(
        spark.read.parquet(f"{out}/far").select("event_id", "layer"), "event_id"
    )
    counters = delivery_counters(delivery.read_log(spark, f"{out}/log"))
    both = stored.agg(F.count(F.lit(1)).alias("n")).select(F.lit("both").alias("sink"), "n")
    return counters.select("sink", "recorded", "failed").unionByName(
        both.select("sink", F.col("n").alias("recorded"), F.lit(0).cast("long").alias("failed"))
    )


def recorded_batches(spark, sf):
    out = shared_dir(spark, "recorder")

    def recorder(batch, params, batch_id):
        counts = batch.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{params['path']}/batch_id={batch_id}")

    finish(
        ingest.record_with(
            event_stream(spark, sf), recorder, {"path": f"{out}/rows"}, f"{out}/checkpoint", available_now=True
        )
    )
    return spark.read.parquet(f"{out}/rows").groupBy("layer").agg(F.sum("n").alias("tiles"))


QUERIES = {
    "stream_ingest": stream_ingest,
    "stream_totals": lambda s, p: _dashboard(s, p, "totals"),
    "stream_by_layer": lambda s, p: _dashboard(s, p, "by_layer"),
    "stream_by_zoom": lambda s, p: _dashboard(s, p, "by_zoom"),
    "stream_windows": windowed_usage,
    "stream_first_fetches": fetch_stream,
    "stream_change_alerts": change_alerts,
    "stream_enriched": enriched_stream,
    "stream_contained_failures": contained_failures,
    "stream_sink_fan_out": sink_fan_out,
    "stream_recorder": recorded_batches,
}

W = "WITH "
SQL = {
    "stream_ingest": W + sql.EV + " SELECT event_id, time, layer, z, x, y, user_id, CAST(bytes AS VARCHAR) AS bytes FROM ev",
    "stream_totals": usage.SQL["usage_totals"],
    "stream_by_layer": usage.SQL["usage_by_layer"],
    "stream_by_zoom": W + sql.EV + " SELECT z, count(*) AS tiles FROM ev GROUP BY z",
    # Windows that end by the final watermark (latest event less the lateness) are out.
    "stream_windows": W + sql.EV + """ SELECT CAST(date_trunc('hour', time) AS TIMESTAMP) AS window_start,
      CAST(date_trunc('hour', time) + INTERVAL 1 HOUR AS TIMESTAMP) AS window_end, layer, z, count(*) AS tiles,
      CAST(sum(bytes) AS BIGINT) AS bytes FROM ev
      WHERE date_trunc('hour', time) + INTERVAL 1 HOUR <= (SELECT max(time) FROM ev) - INTERVAL 2 HOUR GROUP BY 1, 2, 3, 4""",
    "stream_first_fetches": store.SQL["first_fetches"],
    "stream_change_alerts": W + sql.REQ + f""", seen AS (
        SELECT *, concat_ws('/', layer_name, z, x, y) || CASE WHEN request_id % 7 = 0 THEN '-old' ELSE '' END AS content FROM req),
      l AS (SELECT *, lag(content) OVER w AS pc, lag(content_type) OVER w AS pt
        FROM seen WINDOW w AS (PARTITION BY {store.K} ORDER BY time, request_id))
      SELECT {store.K}, request_id AS version, content_type FROM l WHERE pc IS NOT NULL AND (pc <> content OR pt <> content_type)""",
    "stream_enriched": W + logs.AUDIT + " SELECT request_id, layer_id, verdict, CAST(10485760 AS BIGINT) AS max_length FROM v",
    "stream_contained_failures": W + sql.EV + """ SELECT 'webhook' AS sink, 'ConnectionError: refused' AS error,
      count(*) AS events FROM ev""",
    "stream_sink_fan_out": W + sql.EV + """, n AS (SELECT count(*) AS n FROM ev)
      SELECT sink, CASE WHEN sink = 'broken' THEN 0 ELSE n END AS recorded, CASE WHEN sink = 'broken' THEN n ELSE 0 END AS failed
      FROM n, (VALUES ('near'), ('far'), ('broken'), ('both')) s(sink)""",
    "stream_recorder": W + sql.EV + " SELECT layer, count(*) AS tiles FROM ev GROUP BY layer",
}
