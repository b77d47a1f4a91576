"""Usage analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import usage as u
from tessera.operators.layers import expand_refs, resolve_layers
from tessera.operators.numbering import chunk
from tessera.operators.store import cache_lookup, hit_rate
from tessera.plans.queries import sql
from tessera.plans.render import retain_events
from tessera.sources import derived as d
from tessera.sources import sinks
from tessera.sources.catalog import reference_edges
from tessera.sources.events import resolve_fields, to_tile_events
from tessera.sources.logs import format_access_log, parse_access_log, split_rejects

NOW = "TIMESTAMP_NTZ '2024-01-30 12:00:00'"


def events(spark, sf):
    return to_tile_events(d.tile_requests(spark, sf), d.LAYERS)


def resolved(spark, sf):
    return resolve_layers(d.tile_requests(spark, sf), d.LAYERS)


def lookups(spark, sf):
    return cache_lookup(resolved(spark, sf), d.tile_store(spark, sf))


def tile_events(spark, sf):
    return events(spark, sf).select(
        "event_id", "time", "layer", "layer_name", "z", "x", "y", "user_id",
        F.col("extra")["duration"].alias("duration"), F.col("extra")["bytes"].alias("bytes"),
        F.col("extra")["contenttype"].alias("contenttype"),
    )


def optional_fields(spark, sf):
    rows = resolved(spark, sf).withColumn(
        "headers", F.create_map(F.lit("User-Agent"), F.concat(F.lit("agent/"), F.col("z")))
    )
    chosen = resolve_fields(
        rows, ("IP", "layername", "useragent", "referer"),
        {"environment": "demo", "agent": "hdr.user-agent", "code": "ctx.status", "ip": "hidden"},
    )
    extra = rows.select("request_id", chosen.alias("e"))
    return extra.select(
        "request_id", F.array_join(F.array_sort(F.map_keys("e")), ",").alias("names"),
        *[F.try_element_at("e", F.lit(k)).alias(k) for k in ("layername", "useragent", "environment", "agent", "code", "ip")],
    )


def usage_by_tag(spark, sf):
    tagged = to_tile_events(
        d.tile_requests(spark, sf), d.LAYERS, ("bytes", "contenttype"), {"environment": "demo"}
    )
    return u.usage_by(tagged, ["extra.environment", "extra.contenttype"])


def service_counters(spark, sf):
    return u.service_counters(lookups(spark, sf))


def error_breakdown(spark, sf):
    rows = resolved(spark, sf)
    broken = rows.withColumn("x", F.when(F.col("request_id") % 17 == 0, -1).otherwise(F.col("x")))
    return u.error_breakdown(u.classify_errors(broken))


def delivery_counters(spark, sf):
    batches = (
        d.tile_requests(spark, sf)
        .groupBy("layer_name", F.date_trunc("hour", "time").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("request_id").alias("last"))
        .select(
            F.col("layer_name").alias("sink"), "n",
            F.when(F.col("last") % 5 == 0, F.lit("refused")).alias("error"),
        )
    )
    return u.delivery_counters(batches)


def load_summary(spark, sf):
    responses = d.tile_requests(spark, sf).select(
        F.when(F.col("request_id") % 10 != 0, F.col("status")).alias("status"),
        F.col("duration_ms").alias("latency_ms"),
    )
    out = u.load_summary(responses)
    return out.withColumn("by_status", F.to_json("by_status"))


def recent_events(spark, sf):
    return u.recent_events(events(spark, sf)).drop("extra")


def reconcile(spark, sf):
    served = d.tile_requests(spark, sf).where(F.col("status").isin(200, 304))
    good, _ = split_rejects(parse_access_log(format_access_log(served)))
    access = resolve_layers(good, d.LAYERS).withColumn("layer", F.col("layer_id")).withColumn(
        "time", F.col("time").cast("timestamp_ntz")
    )
    access = access.withColumns({c: F.col(c).cast("int") for c in "zxy"})
    kept = events(spark, sf).where(F.col("event_id") % 10 != 0)
    return u.reconcile(access, kept)


def health(spark, sf):
    results = d.tile_requests(spark, sf).where(F.col("user_id") != "").select(
        F.col("user_id").alias("check_id"), F.col("time").alias("ts"), F.lit(86400).alias("ttl_s"),
        F.when(F.col("status") == 500, F.lit("status 500")).alias("error"),
        F.col("request_id").alias("result_id"),
    )
    checks = d.table(spark, sf, "customer").select(
        F.concat(F.lit("user-"), (F.col("c_custkey") % 200).cast("string")).alias("check_id")
    )
    return u.health_rollup(results, checks, F.expr(NOW))


def overall_health(spark, sf):
    return u.overall_health(health(spark, sf))


def layer_requests_with_references(spark, sf):
    rows = resolved(spark, sf).select("request_id", "layer_id", "bytes")
    edges = reference_edges(
        spark,
        {
            "osm-topo": {"name": "blend", "providers": [{"name": "ref", "layer": "osm"}, {"name": "ref", "layer": "osm"}]},
            "debug-grid": {"name": "ref", "layer": "osm-topo"},
        },
    )
    return expand_refs(rows, edges).groupBy(F.col("layer_id").alias("layer"), "hops").agg(
        F.sum("times").alias("requests")
    )


def event_chunks(spark, sf):
    cut = chunk(events(spark, sf), ["layer"], ["time", "event_id"], 25)
    return cut.select("event_id", "layer", "chunk", "pos")


def measurement_payloads(spark, sf):
    tagged = to_tile_events(d.tile_requests(spark, sf), d.LAYERS, ("ip", "bytes"), {"x": "override"})
    return sinks.ga_payloads(tagged)


def webhook_payloads(spark, sf):
    plain = events(spark, sf).withColumn("extra", F.map_filter("extra", lambda k, v: k == "bytes"))
    return sinks.webhook_batches(plain, 200).select("chunk", "n", "payload")


def events_json(spark, sf):
    return sinks.events_json(events(spark, sf), {"user_id": "account"})


def events_map(spark, sf):
    out = sinks.events_map(events(spark, sf))
    return out.select(
        "time", "layer", F.col("z").cast("int").alias("z"), "x", "y", "user_id",
        F.col("extra")["bytes"].alias("bytes"), F.size("extra").alias("fields"),
    )


def retained_events(spark, sf):
    return retain_events(events(spark, sf), F.expr(NOW), 10).groupBy("layer").agg(
        F.count(F.lit(1)).alias("tiles"), F.min("time").alias("first_seen")
    )


QUERIES = {
    "tile_events": tile_events,
    "optional_fields": optional_fields,
    "usage_totals": lambda s, p: u.usage_totals(events(s, p)),
    "usage_by_layer": lambda s, p: u.usage_by_layer(events(s, p)),
    "usage_by_zoom": lambda s, p: u.usage_by_zoom(events(s, p)),
    "usage_by_layer_zoom": lambda s, p: u.usage_by_layer_zoom(events(s, p)),
    "usage_layer_zoom_subtotals": lambda s, p: u.usage_by_layer_zoom(events(s, p), True),
    "usage_by_user": lambda s, p: u.usage_by(events(s, p), ["user_id"]),
    "usage_by_tag": usage_by_tag,
    "upstream_consumption": lambda s, p: u.upstream_consumption(lookups(s, p)),
    "hit_rate": lambda s, p: hit_rate(lookups(s, p), ["layer_id"]),
    "service_counters": service_counters,
    "error_breakdown": error_breakdown,
    "delivery_counters": delivery_counters,
    "load_summary": load_summary,
    "recent_events": recent_events,
    "reconcile_access_log": reconcile,
    "health_rollup": health,
    "overall_health": overall_health,
    "layer_requests_with_references": layer_requests_with_references,
    "event_chunks": event_chunks,
    "measurement_payloads": measurement_payloads,
    "webhook_payloads": webhook_payloads,
    "events_json_sink": events_json,
    "events_map_sink": events_map,
    "retained_events": retained_events,
}

W = "WITH "
_HEALTH = f"""{sql.REQ}, last AS (
  SELECT * FROM (SELECT user_id AS check_id, time AS ts,
      CASE WHEN status = 500 THEN 'status 500' END AS error,
      row_number() OVER (PARTITION BY user_id ORDER BY time DESC, request_id DESC) AS rn
    FROM req WHERE user_id <> '') WHERE rn = 1),
  roll AS (SELECT c.check_id, l.ts,
      CASE WHEN l.check_id IS NULL THEN 'missing' WHEN l.error IS NOT NULL THEN l.error
        WHEN l.ts + INTERVAL 86405 SECOND < TIMESTAMP '2024-01-30 12:00:00' THEN 'stale' END AS output
    FROM (SELECT DISTINCT 'user-' || CAST(c_custkey % 200 AS VARCHAR) AS check_id FROM customer) c
    LEFT JOIN last l USING (check_id))"""

SQL = {
    "tile_events": W + sql.EV + """ SELECT event_id, time, layer, layer_name, z, x, y, user_id,
      CAST(duration_ms AS VARCHAR) AS duration, CAST(bytes AS VARCHAR) AS bytes, content_type AS contenttype FROM ev""",
    "optional_fields": W + sql.REQ + """ SELECT request_id,
      'agent,code,environment,ip,layername,useragent' AS names, layer_name AS layername,
      'agent/' || z AS useragent, 'demo' AS environment, 'agent/' || z AS agent,
      CAST(status AS VARCHAR) AS code, 'hidden' AS ip FROM req""",
    "usage_totals": W + sql.EV + """ SELECT count(*) AS tiles, count(DISTINCT layer) AS layers,
      CAST(round(coalesce(avg(duration_ms), 0)) AS INT) AS avg_duration_ms,
      CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes FROM ev""",
    "usage_by_layer": W + sql.EV + """ SELECT layer, count(*) AS tiles, max(time) AS last_seen,
      CAST(round(coalesce(avg(duration_ms), 0)) AS INT) AS avg_duration_ms FROM ev GROUP BY layer""",
    "usage_by_zoom": W + sql.EV + """, g AS (SELECT z, count(*) AS tiles FROM ev GROUP BY z)
      SELECT z, tiles, tiles / CAST(greatest((SELECT max(tiles) FROM g), 1) AS DOUBLE) AS share FROM g""",
    "usage_by_layer_zoom": W + sql.EV + " SELECT layer, z, count(*) AS tiles FROM ev GROUP BY layer, z",
    "usage_layer_zoom_subtotals": W + sql.EV + " SELECT layer, z, count(*) AS tiles FROM ev GROUP BY ROLLUP (layer, z)",
    "usage_by_user": W + sql.EV + """ SELECT user_id, count(*) AS tiles,
      CAST(sum(bytes) AS BIGINT) AS total_bytes, max(time) AS last_seen FROM ev GROUP BY user_id""",
    "usage_by_tag": W + sql.EV + """ SELECT 'demo' AS environment, content_type AS contenttype,
      count(*) AS tiles, CAST(sum(bytes) AS BIGINT) AS total_bytes, max(time) AS last_seen
      FROM ev GROUP BY content_type""",
    "upstream_consumption": W + sql.LOOK + """ SELECT layer_id AS layer,
      CAST(date_trunc('day', time) AS TIMESTAMP) AS period, count(*) AS requests,
      count(*) FILTER (NOT hit) AS renders,
      CAST(sum(bytes) FILTER (NOT hit) AS BIGINT) AS rendered_bytes
      FROM look WHERE layer_id IS NOT NULL GROUP BY 1, 2""",
    "hit_rate": W + sql.LOOK + """ SELECT layer_id, count(*) FILTER (hit) AS hits,
      count(*) FILTER (NOT hit) AS misses FROM look GROUP BY layer_id""",
    "service_counters": W + sql.LOOK + """, f AS (SELECT *, status IN (200, 304) AS ok FROM look)
      SELECT 'tiles.total.request' AS metric, count(*) AS value FROM f
      UNION ALL SELECT 'tiles.total.valid', count(*) FROM f
      UNION ALL SELECT 'tiles.total.error', count(*) FILTER (NOT ok) FROM f
      UNION ALL SELECT 'tiles.total.success', count(*) FILTER (ok) FROM f
      UNION ALL SELECT 'cache.total.hit', count(*) FILTER (hit) FROM f
      UNION ALL SELECT 'cache.total.miss', count(*) FILTER (NOT hit) FROM f
      UNION ALL SELECT 'tiles.layer.' || layer_id || '.request', count(*) FILTER (NOT hit) FROM f GROUP BY layer_id
      UNION ALL SELECT 'tiles.layer.' || layer_id || '.error', count(*) FILTER (NOT hit AND NOT ok) FROM f GROUP BY layer_id
      UNION ALL SELECT 'tiles.layer.' || layer_id || '.success', count(*) FILTER (NOT hit AND ok) FROM f GROUP BY layer_id""",
    "error_breakdown": W + sql.RES + """ SELECT error_class, reply_status, layer_id AS layer,
      count(*) AS errors, count(DISTINCT user_id) AS users FROM (
        SELECT *, CASE WHEN request_id % 17 = 0 THEN 'bounds' WHEN status = 500 THEN 'provider' END AS error_class,
               CASE WHEN request_id % 17 = 0 THEN 400 ELSE 500 END AS reply_status FROM res)
      WHERE error_class IS NOT NULL GROUP BY 1, 2, 3""",
    "delivery_counters": W + sql.REQ + """, b AS (
        SELECT layer_name AS sink, count(*) AS n, max(request_id) % 5 = 0 AS bad FROM req
        GROUP BY layer_name, date_trunc('hour', time))
      SELECT sink, count(*) AS batches, CAST(coalesce(sum(n) FILTER (NOT bad), 0) AS BIGINT) AS recorded,
        CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS failed FROM b GROUP BY sink""",
    "load_summary": W + sql.REQ + """, r AS (
        SELECT CASE WHEN request_id % 10 <> 0 THEN status END AS status, duration_ms FROM req)
      SELECT count(*) AS total,
        '{"200":' || count(*) FILTER (status = 200) || ',"304":' || count(*) FILTER (status = 304)
          || ',"500":' || count(*) FILTER (status = 500) || '}' AS by_status,
        count(*) FILTER (status IS NULL) AS transport_errors, max(duration_ms) AS max_latency_ms,
        false AS all_ok FROM r""",
    "recent_events": W + sql.EV + """ SELECT event_id, time, layer, z, x, y, user_id FROM ev
      ORDER BY time DESC, event_id DESC LIMIT 15""",
    "reconcile_access_log": W + sql.EV + """, a AS (
        SELECT layer_id AS layer, z, x, y, date_trunc('hour', time) AS bucket, count(*) AS served
        FROM res WHERE status IN (200, 304) GROUP BY 1, 2, 3, 4, 5),
      e AS (SELECT layer, z, x, y, date_trunc('hour', time) AS bucket, count(*) AS recorded
        FROM ev WHERE event_id % 10 <> 0 GROUP BY 1, 2, 3, 4, 5)
      SELECT layer, z, x, y, CAST(bucket AS TIMESTAMP) AS bucket, coalesce(served, 0) AS served,
        coalesce(recorded, 0) AS recorded,
        CASE WHEN coalesce(served, 0) = coalesce(recorded, 0) THEN 'same'
          WHEN coalesce(recorded, 0) = 0 THEN 'unrecorded' WHEN coalesce(served, 0) = 0 THEN 'unserved'
          ELSE 'differs' END AS verdict
      FROM a FULL OUTER JOIN e USING (layer, z, x, y, bucket)""",
    "health_rollup": W + _HEALTH + """ SELECT check_id, ts, output,
      CASE WHEN output IS NULL THEN 'ok' ELSE 'error' END AS status FROM roll""",
    "overall_health": W + _HEALTH + """ SELECT count(*) AS checks,
      count(*) FILTER (output IS NOT NULL) AS failing,
      CASE WHEN bool_and(output IS NULL) THEN 'ok' ELSE 'error' END AS status FROM roll""",
    "layer_requests_with_references": W + sql.RES + """, n AS (
        SELECT layer_id, count(*) AS c FROM res GROUP BY layer_id),
      reach(layer_id, layer, hops, times) AS (VALUES ('osm-topo', 'osm', 1, 2),
        ('debug-grid', 'osm-topo', 1, 1), ('debug-grid', 'osm', 2, 2))
      SELECT layer, hops, CAST(requests AS BIGINT) AS requests FROM (
        SELECT layer_id AS layer, 0 AS hops, c AS requests FROM n
        UNION ALL SELECT r.layer, r.hops, sum(r.times * n.c) FROM n JOIN reach r USING (layer_id) GROUP BY 1, 2)""",
    "event_chunks": W + sql.EV + """ SELECT event_id, layer, CAST((rn - 1) // 25 AS BIGINT) AS chunk,
      CAST((rn - 1) % 25 AS INT) AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY layer ORDER BY time, event_id) AS rn FROM ev)""",
    "measurement_payloads": W + sql.EV + """, k AS (
        SELECT e.*, r.ip, CASE WHEN e.user_id <> '' THEN e.user_id ELSE sha256(r.ip) END AS client_id
        FROM ev e JOIN req r ON r.request_id = e.event_id),
      c AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY time, event_id) - 1 AS rn FROM k)
      SELECT client_id, CAST(rn // 25 AS BIGINT) AS chunk, CAST(count(*) AS INT) AS n,
        '{"client_id":"' || client_id || '"' ||
        CASE WHEN max(user_id) <> '' THEN ',"user_id":"' || max(user_id) || '"' ELSE '' END || ',"events":[' ||
        string_agg('{"name":"tile_request","params":{"bytes":' || bytes || ',"ip":"' || ip || '","layer":"' || layer
          || '","x":"override","y":' || y || ',"z":' || z || '}}', ',' ORDER BY rn) || ']}' AS payload
      FROM c GROUP BY client_id, rn // 25""",
    "webhook_payloads": W + sql.EV + """, c AS (
        SELECT *, row_number() OVER (ORDER BY time, event_id) - 1 AS rn FROM ev)
      SELECT CAST(rn // 200 AS BIGINT) AS chunk, CAST(count(*) AS INT) AS n, '[' ||
        string_agg('{"time":"' || rtrim(rtrim(strftime(time, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z","layer":"' || layer || '","z":' || z ||
          ',"x":' || x || ',"y":' || y || CASE WHEN user_id <> '' THEN ',"user":"' || user_id || '"' ELSE '' END ||
          ',"details":{"bytes":' || bytes || '}}', ',' ORDER BY rn) || ']' AS payload
      FROM c GROUP BY rn // 200""",
    "events_json_sink": W + sql.EV + """ SELECT time, layer, z, x, y, user_id AS account,
      '{"bytes":' || bytes || ',"contenttype":"' || content_type || '","duration":' || duration_ms || '}' AS extra FROM ev""",
    "events_map_sink": W + sql.EV + """ SELECT CAST(date_trunc('second', time) AS TIMESTAMP) AS time, layer, z,
      CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, user_id, CAST(bytes AS VARCHAR) AS bytes, 3 AS fields FROM ev""",
    "retained_events": W + sql.EV + """ SELECT layer, count(*) AS tiles, min(time) AS first_seen FROM ev
      WHERE time >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY layer""",
}
