"""Usage analytics over tile events and request logs.

Every report is one grouped aggregate, so map-side partial aggregation shrinks
a hot layer before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.access import SUCCESS_STATUSES, error_status
from tessera.functions.keys import metric_name
from tessera.functions.tiles import tile_error


def extra_number(name: str) -> Column:
    return F.try_element_at(F.col("extra"), F.lit(name)).try_cast("double")


def _average_ms() -> Column:
    # Rounds half away from zero, as a numeric-to-integer cast does.
    return F.round(F.coalesce(F.avg(extra_number("duration")), F.lit(0.0))).cast("int")


def usage_totals(events: DataFrame) -> DataFrame:
    """One row, also for no events."""
    return events.agg(
        F.count(F.lit(1)).alias("tiles"),
        F.count_distinct("layer").alias("layers"),
        _average_ms().alias("avg_duration_ms"),
        F.round(F.coalesce(F.sum(extra_number("bytes")), F.lit(0.0)))
        .cast("bigint")
        .alias("total_bytes"),
    )


def usage_by_layer(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("layer")
        .agg(
            F.count(F.lit(1)).alias("tiles"),
            F.max("time").alias("last_seen"),
            _average_ms().alias("avg_duration_ms"),
        )
        .orderBy(F.desc("tiles"), "layer")
    )


def usage_by_zoom(events: DataFrame) -> DataFrame:
    """Tiles per zoom and each zoom's share of the largest (at most 22 rows)."""
    zooms = events.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"))
    largest = F.greatest(F.max("tiles").over(Window.partitionBy()), F.lit(1))
    return zooms.withColumn("share", F.col("tiles") / largest).orderBy("z")


def usage_by_layer_zoom(events: DataFrame, subtotals: bool = False) -> DataFrame:
    grouped = events.rollup("layer", "z") if subtotals else events.groupBy("layer", "z")
    return grouped.agg(F.count(F.lit(1)).alias("tiles")).orderBy(
        F.desc("tiles"), F.asc_nulls_first("layer"), F.asc_nulls_first("z")
    )


def usage_by(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Usage per user, tenant or tag; ``extra.name`` reads an optional field."""
    cols = [
        F.try_element_at(F.col("extra"), F.lit(k[6:])).alias(k[6:])
        if k.startswith("extra.")
        else F.col(k)
        for k in keys
    ]
    return events.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("tiles"),
        F.round(F.coalesce(F.sum(extra_number("bytes")), F.lit(0.0)))
        .cast("bigint")
        .alias("total_bytes"),
        F.max("time").alias("last_seen"),
    )


def recent_events(events: DataFrame, n: int = 15) -> DataFrame:
    """The latest events; a top-k, so no full sort."""
    return (
        events.orderBy(F.desc("time"), F.desc("event_id"))
        .limit(n)
        .select(
            "event_id", "time", "layer", "z", "x", "y",
            F.coalesce("user_id", F.lit("")).alias("user_id"), "extra",
        )
    )


def upstream_consumption(lookups: DataFrame, period: str = "day") -> DataFrame:
    """Renders per layer and period: lookups that missed plus layers without cache."""
    rendered = F.col("skip_cache") | ~F.coalesce("hit", F.lit(False))
    return (
        lookups.where(F.col("layer_id").isNotNull())
        .groupBy(F.col("layer_id").alias("layer"), F.date_trunc(period, "time").alias("period"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(rendered).alias("renders"),
            F.sum(F.when(rendered, F.col("bytes"))).alias("rendered_bytes"),
        )
    )


def request_outcomes(requests: DataFrame) -> DataFrame:
    """Add ``valid``, ``success`` and ``failed`` flags.

    Valid means authenticated with legal coordinates; a failed request is a valid
    one that gave no tile.  ``auth_ok`` is optional and defaults to true.
    """
    auth = F.coalesce("auth_ok", F.lit(True)) if "auth_ok" in requests.columns else F.lit(True)
    valid = auth & tile_error("z", "x", "y").isNull()
    success = valid & F.col("status").isin(*SUCCESS_STATUSES)
    return requests.select(
        "*", valid.alias("valid"), success.alias("success"), (valid & ~success).alias("failed")
    )


# Counter names and the aggregate each one reads.
TOTAL_COUNTERS = {
    "tiles.total.request": "all",
    "tiles.total.valid": "valid",
    "tiles.total.error": "failed",
    "tiles.total.success": "success",
    "cache.total.hit": "hit",
    "cache.total.miss": "miss",
}
LAYER_COUNTERS = {".request": "r_all", ".error": "r_failed", ".success": "r_success"}


def service_counters(lookups: DataFrame) -> DataFrame:
    """Long-form counters from one pass over resolved, cache-checked requests.

    Layer counters cover rendered requests only: cache misses and uncached layers.
    """
    flagged = request_outcomes(lookups)
    known = F.col("valid") & F.col("layer_id").isNotNull()
    looked_up = known & ~F.coalesce("skip_cache", F.lit(False))
    hit = looked_up & F.col("hit")
    rendered = known & ~hit
    per_layer = flagged.groupBy("layer_id").agg(
        F.count(F.lit(1)).alias("all"),
        F.count_if("valid").alias("valid"),
        F.count_if("success").alias("success"),
        F.count_if("failed").alias("failed"),
        F.count_if(hit).alias("hit"),
        F.count_if(looked_up & ~F.col("hit")).alias("miss"),
        F.count_if(rendered).alias("r_all"),
        F.count_if(rendered & F.col("success")).alias("r_success"),
        F.count_if(rendered & F.col("failed")).alias("r_failed"),
    )
    # From here on there is one row per layer of the catalog.  Each adds to the
    # totals and to its own counters, so the log is aggregated once.
    layer = F.concat(F.lit("tiles.layer."), metric_name("layer_id"))
    counters = [(F.lit(metric), c) for metric, c in TOTAL_COUNTERS.items()]
    counters += [(F.concat(layer, F.lit(end)), c) for end, c in LAYER_COUNTERS.items()]
    rows = per_layer.select(
        F.inline(F.array(*[F.struct(m.alias("metric"), F.col(c).alias("value")) for m, c in counters]))
    ).where(F.col("metric").isNotNull())
    zeros = lookups.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(m) for m in TOTAL_COUNTERS])).alias("metric"),
        F.lit(0).cast("long").alias("value"),
    )
    # Two layer ids may share one metric name; their counts add up.
    return rows.unionByName(zeros).groupBy("metric").agg(F.sum("value").alias("value"))


def classify_errors(resolved: DataFrame) -> DataFrame:
    """Add ``error_class`` (null for a served tile) to resolved requests."""
    bad_tile = tile_error("z", "x", "y").isNotNull()
    unknown = F.col("layer_id").isNull()
    served = F.col("status").isin(*SUCCESS_STATUSES)
    cls = (
        F.when(bad_tile, F.lit("bounds"))
        .when(unknown, F.lit("auth"))
        .when(served, F.lit(None).cast("string"))
        .when(F.col("status") == 401, F.lit("auth"))
        .when(F.col("status") == 400, F.lit("badrequest"))
        .when(F.col("status") == 499, F.lit("cancelled"))
        .when(F.col("status") == 500, F.lit("provider"))
        .otherwise(F.lit("other"))
    )
    return resolved.withColumn("error_class", cls)


def error_breakdown(classified: DataFrame, always_ok: bool = False) -> DataFrame:
    return (
        classified.where(F.col("error_class").isNotNull())
        .groupBy(
            "error_class",
            error_status("error_class", always_ok).alias("reply_status"),
            F.col("layer_id").alias("layer"),
        )
        .agg(F.count(F.lit(1)).alias("errors"), F.count_distinct("user_id").alias("users"))
    )


def delivery_counters(batches: DataFrame) -> DataFrame:
    """Recorded and failed events per sink from a batch log (sink, n, error)."""
    ok = F.col("error").isNull()
    return batches.groupBy("sink").agg(
        F.count(F.lit(1)).alias("batches"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).cast("long").alias("recorded"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).cast("long").alias("failed"),
    )


def load_summary(responses: DataFrame) -> DataFrame:
    """One row for a load run; ``status`` is null for a transport error."""
    by_status = responses.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("latest")
    )
    # Status codes are few, so the map below is small.
    seen = F.filter(
        F.collect_list(F.struct(F.col("status").cast("int").alias("k"), F.col("n").alias("v"))),
        lambda e: e["k"].isNotNull(),
    )
    transport = F.coalesce(F.sum(F.when(F.col("status").isNull(), F.col("n"))), F.lit(0))
    good = F.coalesce(F.sum(F.when(F.col("status") == 200, F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return by_status.agg(
        total.cast("long").alias("total"),
        F.map_from_entries(F.array_sort(seen)).alias("by_status"),
        transport.cast("long").alias("transport_errors"),
        F.max("latest").alias("max_latency_ms"),
        ((transport == 0) & (total > 0) & (good == total)).alias("all_ok"),
    )


def reconcile(access: DataFrame, events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Served against recorded tiles per (layer, z, x, y, time bucket).

    Both sides are aggregated before they meet, so a hot tile is one row each.
    """
    keys = ["layer", "z", "x", "y", "bucket"]

    def counts(df: DataFrame, name: str) -> DataFrame:
        cut = df.withColumn("bucket", F.date_trunc(bucket, F.col("time")))
        return cut.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    both = counts(access, "served").join(counts(events, "recorded"), keys, "full_outer")
    served, recorded = F.coalesce("served", F.lit(0)), F.coalesce("recorded", F.lit(0))
    return both.select(
        *keys,
        served.alias("served"),
        recorded.alias("recorded"),
        F.when(served == recorded, F.lit("same"))
        .when(recorded == 0, F.lit("unrecorded"))
        .when(served == 0, F.lit("unserved"))
        .otherwise(F.lit("differs"))
        .alias("verdict"),
    )


def health_rollup(results: DataFrame, checks: DataFrame, now, leeway_s: int = 5) -> DataFrame:
    """Latest state of every expected check; missing, failed or stale is not ok."""
    latest = results.groupBy("check_id").agg(
        F.max_by(F.struct("ts", "ttl_s", "error"), F.struct("ts", "result_id")).alias("r")
    )
    joined = checks.select("check_id").distinct().join(latest, "check_id", "left")
    fresh_until = F.timestamp_add("SECOND", F.col("r.ttl_s") + leeway_s, F.col("r.ts"))
    output = (
        F.when(F.col("r").isNull(), F.lit("missing"))
        .when(F.col("r.error").isNotNull(), F.col("r.error"))
        .when(fresh_until < now, F.lit("stale"))
    )
    return joined.select(
        "check_id",
        F.col("r.ts").alias("ts"),
        output.alias("output"),
        F.when(output.isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
    )


def overall_health(rollup: DataFrame) -> DataFrame:
    return rollup.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") != "ok").alias("failing"),
        F.when(F.bool_and(F.col("status") == "ok"), F.lit("ok"))
        .otherwise(F.lit("error"))
        .alias("status"),
    )
