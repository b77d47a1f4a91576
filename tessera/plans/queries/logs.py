"""Log sources, keys, URLs, policies, permissions and pattern queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import access as a
from tessera.functions import keys as k
from tessera.functions.patterns import compile_pattern, match_layer, params_valid
from tessera.functions.urls import expand_url, redact_url, rewrite_wms
from tessera.operators.access import (
    audit,
    audit_summary,
    extract_token,
    grants_from_claims,
    merge_grants,
    token_accepted,
    validate_tokens,
)
from tessera.operators.layers import expand_pattern_column, resolve_layers, with_policy
from tessera.plans.queries import sql
from tessera.plans.queries.usage import resolved
from tessera.sources import derived as d
from tessera.sources.catalog import Layer
from tessera.sources.logs import format_access_log, parse_access_log, parse_app_log, scrub_log, split_rejects
from tessera.sources.store import parse_store_key


def access_log(spark, sf):
    good, _ = split_rejects(parse_access_log(format_access_log(d.tile_requests(spark, sf))))
    return good.select(
        "ip", "user_id", F.col("time").cast("timestamp_ntz").alias("time"), "method", "uri", "proto",
        "status", "bytes", "layer_name", "z", "x", "y",
    )


def access_log_rejects(spark, sf):
    i = F.col("request_id")
    rows = d.tile_requests(spark, sf)
    text = F.concat(
        F.col("ip"), F.lit(" - - ["),
        F.when(i % 5 == 0, F.lit("no time")).otherwise(F.date_format("time", "dd/MMM/yyyy:HH:mm:ss")),
        F.lit(' +0000] "GET /tiles/'), F.col("layer_name"),
        F.when(i % 5 == 1, F.lit("/a/b/c")).when(i % 5 == 2, F.lit("")).otherwise(F.lit("/1/0/0")),
        F.when(i % 5 == 3, F.lit(' HTTP/1.1')).otherwise(F.lit(' HTTP/1.1" 200 5 "-" "agent \\"x\\""')),
    )
    parsed = parse_access_log(rows.select(text.alias("value")), "combined")
    return parsed.groupBy(F.coalesce("reject", F.lit("good")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("lines"), F.coalesce(F.max("user_agent"), F.lit("")).alias("agent")
    )


def app_log(spark, sf):
    i = F.col("request_id")
    line = F.to_json(
        F.struct(
            F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
            F.lit("INFO").alias("level"), F.lit("served").alias("message"),
            F.concat(F.lit("/tiles/"), F.col("layer_name")).alias("path"),
            F.col("ip"), F.col("user_id").alias("user"), F.lit("agent").alias("user-agent"),
            F.create_map(F.lit("v"), F.array(F.col("status").cast("string"))).alias("query"),
        )
    )
    broken = F.when(i % 50 == 0, F.concat(F.lit("oops "), line)).otherwise(line)
    parsed = parse_app_log(d.tile_requests(spark, sf).select(broken.alias("value")), ["User-Agent"])
    return parsed.select(
        F.col("time").cast("timestamp_ntz").alias("time"), "message", "path", "ip", F.col("user").alias("user_id"),
        F.col("user-agent").alias("agent"), F.get(F.col("query")["v"], F.lit(0)).alias("v"),
        F.col("_corrupt_record").isNotNull().alias("corrupt"),
    )


def scrubbed_log(spark, sf):
    log = d.request_urls(spark, sf).select(
        "page_id", F.col("url").alias("uri"),
        F.concat(F.lit("10.0.0."), (F.col("page_id") % 50).cast("string")).alias("ip"),
        F.lit("agent").alias("user_agent"),
    )
    return scrub_log(log)


def store_inventory(spark, sf):
    r = d.tile_requests(spark, sf)
    out = r
    for layout, prefix in (("disk", ""), ("object", "tiles/v1/"), ("redis", "p:"), ("memcache", "m-")):
        key = k.store_key(layout, "layer_name", "z", "x", "y", prefix)
        parsed = parse_store_key(key, layout, "" if layout in ("disk", "object") else prefix)
        out = out.withColumn(layout, key).withColumn(
            f"{layout}_tile", F.concat_ws("|", parsed["layer_name"], *[parsed[c].cast("string") for c in "zxy"])
        )
    names = ("disk", "object", "redis", "memcache")
    return out.select("request_id", *names, *[f"{n}_tile" for n in names])


def expanded_urls(spark, sf):
    rows = resolved(spark, sf)
    url = expand_url(
        "{env.BASE}/{layer.version}/{Z}/{x}/{y}.png?user={ctx.user}&bbox={xmin},{ymin},{xmax},{ymax}&y={y}",
        "z", "x", "y", "layer_params", {"user": F.concat(F.col("user_id"), F.lit(" &?/~*"))},
        invert_y=True, env={"BASE": "https://tiles.example.com/v1?a=b"},
    )
    return rows.select("request_id", url.alias("url"))


def wms_urls(spark, sf):
    template = rewrite_wms(
        "http://wms.example.com/?bbox=$xmin,$ymin,$xmax,$ymax&w=$width&h=$height&srs=$srs&z=$zoom", height=512
    )
    rows = d.tile_requests(spark, sf)
    return rows.select("request_id", expand_url(template, "z", "x", "y").alias("url"))


def redacted_urls(spark, sf):
    return d.request_urls(spark, sf).select("page_id", redact_url("url").alias("url"))


def safe_names(spark, sf):
    return d.table(spark, sf, "pages").select(
        "page_id", k.safe_layer("url").alias("safe"), k.metric_name("html").alias("metric")
    )


def bounded_keys(spark, sf):
    body = F.concat(k.safe_layer("text"), F.lit("/3/2/1"))
    return d.table(spark, sf, "documents").select(
        "doc_id", k.bounded_key(F.lit("cache_"), body).alias("key")
    )


def etags(spark, sf):
    i = F.col("version")
    tag = k.etag("content")
    header = (
        F.when(i % 5 == 0, F.lit(""))
        .when(i % 5 == 1, F.lit("*"))
        .when(i % 5 == 2, F.concat(F.lit('"other" , W/'), tag, F.lit(" ")))
        .when(i % 5 == 3, F.concat(F.lit("w/"), tag))
        .otherwise(tag)
    )
    return d.tile_store(spark, sf).select(
        "version", tag.alias("etag"), k.etag_matches(header, tag).alias("not_modified")
    )


def error_statuses(spark, sf):
    i = F.col("request_id")
    names = ["auth", "bounds", "provider", "badrequest", "other", "cancelled", "strange"]
    cls = F.get(F.array(*[F.lit(n) for n in names]), (i % 8).cast("int"))
    return d.tile_requests(spark, sf).select(
        "request_id", a.error_status(cls).alias("status"), a.error_status(cls, True).alias("always_ok")
    )


POLICY_LAYERS = (
    Layer("osm", client=a.ResponsePolicy(statuses=(200, 304), max_length=15000, rewrite={"image/png": "image/x-png"})),
    Layer("osm-topo", client=a.ResponsePolicy(statuses=(), content_types=("image/png",), max_length=0, unknown_length=True, rewrite={})),
    *d.LAYERS[2:],
)


def response_verdicts(spark, sf):
    i = F.col("request_id")
    rows = with_policy(resolved(spark, sf), POLICY_LAYERS, a.ResponsePolicy(max_length=18000))
    ctype = F.when(i % 9 == 0, F.lit("text/html")).otherwise(F.col("content_type"))
    declared = F.when(i % 11 == 0, F.lit(-1)).otherwise(F.col("bytes"))
    v = a.response_verdict("status", ctype, declared, "bytes", "policy")
    return rows.select("request_id", v["error"].alias("error"), v["content_type"].alias("content_type"))


def clients(spark, sf):
    user = F.when(F.col("request_id") % 4 == 0, F.lit("")).otherwise(F.col("user_id"))
    ip = F.when(F.col("request_id") % 8 == 0, F.lit("")).otherwise(k.remote_ip(F.concat("ip", F.lit(":443"))))
    return d.tile_requests(spark, sf).select("request_id", k.client_id(user, ip).alias("client_id"), ip.alias("ip"))


def colors(spark, sf):
    i = F.col("event_id")
    code = F.substring(F.md5(i.cast("string").cast("binary")), F.lit(1), (i % 7 + 2).cast("int"))
    code = F.when(i % 9 == 0, F.concat(F.lit("g"), code)).otherwise(F.upper(code))
    coded = d.table(spark, sf, "events").select("event_id", code.alias("code"))
    return coded.withColumn("c", k.parse_color("code")).select(
        "event_id", "code", *[F.col("c")[b].alias(b) for b in "rgba"]
    )


def scopes(spark, sf):
    scope = F.concat_ws(" ", F.concat(F.lit("tile/"), F.col("layer_name")), F.col("user_id"), F.lit("tile/base"))
    scope = F.when(F.col("request_id") % 6 != 0, scope)
    return d.tile_requests(spark, sf).select(
        "request_id", F.array_join(a.scope_layers(scope, "tile/"), ",").alias("layers"),
        a.scope_valid(scope, "user-7", True).alias("valid"), a.scope_valid(scope).alias("free"),
    )


def claims(spark, sf):
    i = F.col("request_id")
    now = F.unix_timestamp(F.col("time").cast("timestamp"))
    ok = a.claims_valid(
        F.when(i % 13 != 0, now + i % 100000 - 5000), now, F.array(F.lit("x"), F.col("layer_name")),
        "user_id", F.lit("issuer"), audience="osm", issuer="issuer",
        nbf=F.when(i % 3 != 0, now + i % 11),
    )
    return d.tile_requests(spark, sf).select("request_id", ok.alias("valid"))


def layer_matches(spark, sf):
    storm = compile_pattern("harbour_{kind}_{version}")
    county = compile_pattern("c{a}s_1{year}")
    m, c = match_layer("layer_name", storm), match_layer("layer_name", county)
    return d.tile_requests(spark, sf).select(
        "request_id", m["kind"].alias("kind"), m["version"].alias("version"),
        F.when(m.isNotNull(), params_valid(m, {"*": "[a-z0-9]+", "version": "^2023.*a$"})).alias("valid"),
        c["a"].alias("a"), c["year"].alias("year"),
    )


def resolved_layers(spark, sf):
    rows = resolved(spark, sf)
    broken = rows.select("request_id", F.concat("layer_name", F.when(F.col("request_id") % 6 == 0, F.lit("!")).otherwise(F.lit(""))).alias("layer_name"))
    out = resolve_layers(broken, d.LAYERS)
    return out.select(
        "request_id", "layer_id", "layer_ord", "skip_analytics",
        F.try_element_at("layer_params", F.lit("version")).alias("version"),
        F.try_element_at("layer_params", F.lit("year")).alias("year"),
    )


def storm_layers_by_user(spark, sf):
    m = match_layer("layer_name", compile_pattern("harbour_survey_{v}"))
    versions = d.tile_requests(spark, sf).select("user_id", m["v"].alias("v")).where(F.col("v").isNotNull())
    # Versions come from the layer catalog, so a user's list is short.
    lists = versions.distinct().groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list("v")), lambda v: F.create_map(F.lit("v"), v)).alias("values")
    )
    return lists.select("user_id", F.inline(expand_pattern_column(F.lit("storm/{v}/{w}"), "values")))


def permissions(spark, sf):
    return audit(resolved(spark, sf), d.grants(spark)).select("request_id", "verdict")


def permission_summary(spark, sf):
    return audit_summary(audit(resolved(spark, sf), d.grants(spark)))


def granted_layers(spark, sf):
    r = d.tile_requests(spark, sf)
    decoded = r.select(
        F.col("request_id").cast("string").alias("token"), "user_id",
        F.concat(F.lit("read tile/"), F.col("layer_name")).alias("scope"),
        F.when(F.col("request_id") % 3 == 0, F.lit("a!")).otherwise(F.lit("gb")).alias("geohash"),
        F.lit(True).alias("partial"),
    )
    merged = merge_grants(grants_from_claims(decoded, "read", True, "tile/"))
    return merged.select("user_id", F.array_join("allowed_layers", ",").alias("layers"))


def token_checks(spark, sf):
    i = F.col("request_id")
    rows = d.tile_requests(spark, sf).withColumns(
        {
            "headers": F.when(i % 3 == 0, F.create_map(F.lit("X-Token"), F.col("user_id"))),
            "cookies": F.create_map().cast("map<string,string>"),
            "query_params": F.when(i % 3 == 1, F.create_map(F.lit("t"), F.col("user_id"))),
            "path": F.concat(F.lit("/tiles/"), k.tile_key("layer_name", "z", "x", "y"),
                             F.when(i % 6 == 2, F.lit("/user-1")).otherwise(F.lit(""))),
        }
    )
    token = extract_token({"header": "X-Token", "cookie": "c", "query": "t", "path": ""})
    tokened = rows.withColumn("token", token)

    def validate(text):
        number = int(text.removeprefix("user-") or 0)
        return number % 4 != 0, 1_704_067_200 + number * 86_400, text, ["osm"] if number % 2 else []

    now = F.unix_timestamp(F.col("time").cast("timestamp"))
    return validate_tokens(tokened, validate).select(
        "request_id", "token", token_accepted(now).alias("accepted"),
        F.coalesce("auth.limit_layers", F.lit(False)).alias("limited"),
    )


def long_catalog(spark, sf):
    """10,000 literal layers and 500 patterns over names made from the line items."""
    layers = [Layer(f"part-{i}") for i in range(10_000)]
    layers += [Layer(f"supplier_{i}", f"sup{i}-{{line}}", {"line": "[1-4]"}) for i in range(500)]
    items = d.table(spark, sf, "lineitem")
    part = F.concat(F.lit("part-"), (F.col("l_partkey") * 7 % 20_000).cast("string"))
    supplier = F.concat(F.lit("sup"), (F.col("l_suppkey") % 600).cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    names = items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"),
        F.when(F.col("l_orderkey") % 2 == 0, part).otherwise(supplier).alias("layer_name"),
    )
    return resolve_layers(names, layers).select(
        "item", "layer_id", F.try_element_at("layer_params", F.lit("line")).alias("line")
    )


QUERIES = {
    "long_catalog": long_catalog,
    "access_log": access_log,
    "access_log_rejects": access_log_rejects,
    "app_log": app_log,
    "scrubbed_log": scrubbed_log,
    "store_keys": store_inventory,
    "expanded_urls": expanded_urls,
    "wms_urls": wms_urls,
    "redacted_urls": redacted_urls,
    "safe_names": safe_names,
    "bounded_keys": bounded_keys,
    "etags": etags,
    "error_statuses": error_statuses,
    "response_verdicts": response_verdicts,
    "clients": clients,
    "colors": colors,
    "scopes": scopes,
    "claims": claims,
    "layer_matches": layer_matches,
    "resolved_layers": resolved_layers,
    "storm_layers_by_user": storm_layers_by_user,
    "permissions": permissions,
    "permission_summary": permission_summary,
    "granted_layers": granted_layers,
    "token_checks": token_checks,
}

W = "WITH "
_URL = """u AS (SELECT page_id, split_part(url, '#', 1) AS base,
    CASE WHEN strpos(url, '#') > 0 THEN '#' || split_part(url, '#', 2) ELSE '' END AS frag FROM pages),
  q AS (SELECT *, split_part(base, '?', 1) AS head,
    list_sort(list_transform(list_filter(string_split(split_part(base, '?', 2), '&') || ['token=redacted'],
      lambda x: x <> ''), lambda x: x)) AS params FROM u),
  red AS (SELECT page_id, head || '?' || array_to_string(params, '&') || CASE WHEN frag = '#' THEN '' ELSE frag END AS url FROM q)"""
_SB = {"s": sql.lat_edge("y + 1"), "n": sql.lat_edge("y"), "w": sql.lon_edge("x"), "e": sql.lon_edge("x + 1")}
AUDIT = sql.RES + f""", v AS (SELECT *, CASE
      WHEN layer_id IS NULL THEN 'unknown'
      WHEN user_id = 'user-1' AND layer_id <> 'osm' THEN 'layer'
      WHEN user_id = 'user-2' AND NOT ({_SB['n']} > 45 AND {_SB['s']} < 50.625 AND {_SB['e']} > -11.25 AND {_SB['w']} < 0) THEN 'area'
      WHEN user_id = 'user-3' AND NOT ({_SB['s']} + 0.00000001 >= {sql.lat_edge('3', '3')}
        AND {_SB['n']} <= {sql.lat_edge('2', '3')} + 0.00000001 AND {_SB['w']} + 0.00000001 >= 0 AND {_SB['e']} <= 45 + 0.00000001) THEN 'area'
      ELSE 'ok' END AS verdict FROM res)"""

SQL = {
    "access_log": W + sql.REQ + """ SELECT ip, user_id, CAST(date_trunc('second', time) AS TIMESTAMP) AS time, 'GET' AS method,
      '/tiles/' || layer_name || '/' || z || '/' || x || '/' || y AS uri, 'HTTP/1.1' AS proto, status, bytes, layer_name,
      CAST(z AS BIGINT) AS z, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM req""",
    "access_log_rejects": W + sql.REQ + """, v AS (SELECT CASE request_id % 5 WHEN 0 THEN 'time' WHEN 1 THEN 'BadRequest'
        WHEN 2 THEN 'NotFound' WHEN 3 THEN 'format' ELSE 'good' END AS verdict FROM req)
      SELECT verdict, count(*) AS lines, CASE WHEN verdict = 'format' THEN '' ELSE 'agent "x"' END AS agent FROM v GROUP BY 1""",
    "app_log": W + sql.REQ + """, b AS (SELECT *, request_id % 50 = 0 AS bad FROM req)
      SELECT CASE WHEN NOT bad THEN time END AS time, CASE WHEN NOT bad THEN 'served' END AS message,
        CASE WHEN NOT bad THEN '/tiles/' || layer_name END AS path, CASE WHEN NOT bad THEN ip END AS ip,
        CASE WHEN NOT bad THEN user_id END AS user_id, CASE WHEN NOT bad THEN 'agent' END AS agent,
        CASE WHEN NOT bad THEN CAST(status AS VARCHAR) END AS v, bad AS corrupt FROM b""",
    "scrubbed_log": W + _URL + """ SELECT page_id, url AS uri,
      sha256('10.0.0.' || (page_id % 50)) AS ip FROM red""",
    "store_keys": W + sql.REQ + """, t AS (SELECT *, concat_ws('/', layer_name, z, x, y) AS k,
        concat_ws('|', layer_name, z, x, y) AS p FROM req)
      SELECT request_id, concat_ws('_', layer_name, z, x, y) AS disk, 'tiles/v1/' || k AS object,
        'p:' || k AS redis, 'm-' || k AS memcache, p AS disk_tile, p AS object_tile, p AS redis_tile, p AS memcache_tile FROM t""",
    "expanded_urls": W + sql.RES + f""" SELECT request_id, 'https://tiles.example.com/v1?a=b/'
      || CASE WHEN layer_id = 'harbour_survey_by_date' THEN substr(layer_name, 16) ELSE '' END
      || '/' || z || '/' || x || '/' || CAST(pow(2, z) - y - 1 AS INT) || '.png?user=' || user_id || '+%26%3F%2F~%2A&bbox='
      || printf('%.6f,%.6f,%.6f,%.6f', {_SB['w']}, {_SB['s']}, {_SB['e']}, {_SB['n']})
      || '&y=' || CAST(pow(2, z) - y - 1 AS INT) AS url FROM res""",
    "wms_urls": W + sql.REQ + f""" SELECT request_id, 'http://wms.example.com/?bbox='
      || printf('%.6f,%.6f,%.6f,%.6f', {_SB['w']}, {_SB['s']}, {_SB['e']}, {_SB['n']})
      || '&w=256&h=512&srs=4326&z=' || z AS url FROM req""",
    "redacted_urls": W + _URL + " SELECT page_id, url FROM red",
    "safe_names": """SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9.-]', '_', 'g'), '\\.{2,}', '_', 'g') AS safe,
      substr(regexp_replace(html, '[^A-Za-z0-9_-]', '_', 'g'), 1, 200) AS metric FROM pages""",
    "bounded_keys": """WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z0-9.-]', '_', 'g'), '\\.{2,}', '_', 'g') AS n FROM documents),
      f AS (SELECT doc_id, CASE WHEN n = '.' THEN '_' ELSE n END || '/3/2/1' AS body FROM b)
      SELECT doc_id, CASE WHEN length(body) + 6 <= 250 THEN 'cache_' || body
        ELSE 'cache_' || substr(body, 1, 250 - 6 - 17) || '_' || substr(sha256('cache_' || body), 1, 16) END AS key FROM f""",
    "etags": W + sql.REQ + ", " + sql.store() + """ SELECT version, '"' || sha256(content) || '"' AS etag,
      version % 5 IN (1, 2, 4) AS not_modified FROM store""",
    "error_statuses": """SELECT event_id AS request_id,
      CASE event_id % 8 WHEN 0 THEN 401 WHEN 1 THEN 400 WHEN 3 THEN 400 WHEN 5 THEN 499 WHEN 7 THEN NULL ELSE 500 END AS status,
      CASE event_id % 8 WHEN 5 THEN 499 WHEN 7 THEN NULL ELSE 200 END AS always_ok FROM events""",
    "response_verdicts": W + sql.RES + """, t AS (SELECT *, CASE WHEN request_id % 9 = 0 THEN 'text/html' ELSE content_type END AS ct,
        CASE WHEN request_id % 11 = 0 THEN -1 ELSE bytes END AS declared,
        CASE WHEN layer_id = 'osm' THEN 15000 ELSE 18000 END AS cap FROM res),
      v AS (SELECT *, CASE WHEN NOT (status = 200 OR (layer_id = 'osm' AND status = 304)) THEN 'status'
          WHEN ct = 'text/html' THEN 'content_type'
          WHEN declared = -1 AND layer_id IS DISTINCT FROM 'osm-topo' THEN 'length'
          WHEN bytes > cap THEN 'length' END AS error FROM t)
      SELECT request_id, error, CASE WHEN error IS NULL THEN CASE WHEN layer_id = 'osm' AND ct = 'image/png'
        THEN 'image/x-png' ELSE ct END END AS content_type FROM v""",
    "clients": W + sql.REQ + """, t AS (SELECT request_id, CASE WHEN request_id % 4 = 0 THEN '' ELSE user_id END AS u,
        CASE WHEN request_id % 8 = 0 THEN '' ELSE ip END AS ip FROM req)
      SELECT request_id, CASE WHEN u <> '' THEN u WHEN ip <> '' THEN sha256(ip) ELSE 'anonymous' END AS client_id, ip FROM t""",
    "colors": """WITH c AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'g' || h ELSE upper(h) END AS code
        FROM (SELECT event_id, substr(md5(CAST(event_id AS VARCHAR)), 1, CAST(event_id % 7 + 2 AS INT)) AS h FROM events)),
      w AS (SELECT *, length(code) IN (3, 4, 6, 8) AND strpos(code, 'g') = 0 AS ok,
        CASE WHEN length(code) < 6 THEN array_to_string(list_transform(string_split(lower(code), ''), lambda x: x || x), '') ELSE lower(code) END AS h FROM c),
      n AS (SELECT *, list_transform(string_split(h, ''), lambda x: strpos('0123456789abcdef', x) - 1) AS v FROM w)
      SELECT event_id, code, CASE WHEN ok THEN CAST(v[1] * 16 + v[2] AS INT) END AS r, CASE WHEN ok THEN CAST(v[3] * 16 + v[4] AS INT) END AS g,
        CASE WHEN ok THEN CAST(v[5] * 16 + v[6] AS INT) END AS b,
        CASE WHEN ok THEN CASE WHEN length(code) IN (4, 8) THEN CAST(v[7] * 16 + v[8] AS INT) ELSE 255 END END AS a FROM n""",
    "scopes": W + sql.REQ + """ SELECT request_id, CASE WHEN request_id % 6 <> 0 THEN layer_name || ',base' END AS layers,
      CASE WHEN request_id % 6 = 0 THEN false ELSE user_id = 'user-7' END AS valid, true AS free FROM req""",
    "claims": W + sql.REQ + """ SELECT request_id, request_id % 13 <> 0 AND request_id % 100000 - 5000 BETWEEN 0 AND 86400
      AND layer_name = 'osm' AND (request_id % 3 = 0 OR request_id % 11 <= 5) AS valid FROM req""",
    "layer_matches": W + sql.REQ + """, t AS (SELECT *, starts_with(layer_name, 'harbour_') AS n, starts_with(layer_name, 'counties_1') AS c FROM req)
      SELECT request_id, CASE WHEN n THEN 'survey' END AS kind, CASE WHEN n THEN substr(layer_name, 16) END AS version,
        CASE WHEN n THEN ends_with(layer_name, 'a') END AS valid, CASE WHEN c THEN 'ountie' END AS a,
        CASE WHEN c THEN substr(layer_name, 11) END AS year FROM t""",
    "resolved_layers": W + sql.RES + """ SELECT request_id, id AS layer_id,
        CAST(CASE id WHEN 'osm' THEN 0 WHEN 'osm-topo' THEN 1 WHEN 'harbour_survey_by_date' THEN 2
          WHEN 'counties_by_year' THEN 3 WHEN 'debug-grid' THEN 4 END AS INT) AS layer_ord,
        CASE WHEN id IS NOT NULL THEN id = 'debug-grid' END AS skip_analytics,
        CASE WHEN id LIKE 'harbour%' THEN substr(layer_name, 16) END AS version,
        CASE WHEN id LIKE 'counties%' THEN substr(layer_name, 10) END AS year
      FROM (SELECT *, CASE WHEN request_id % 6 <> 0 THEN layer_id END AS id FROM res)""",
    "storm_layers_by_user": W + sql.REQ + """, v AS (SELECT DISTINCT user_id, substr(layer_name, 16) AS v FROM req WHERE starts_with(layer_name, 'harbour_'))
      SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY v) - 1 AS INT) AS ord, 'storm/' || v || '/{w}' AS layer FROM v""",
    "permissions": W + AUDIT + " SELECT request_id, verdict FROM v",
    "permission_summary": W + AUDIT + """ SELECT user_id, verdict, count(*) AS requests,
      count(DISTINCT layer_id) AS layers FROM v GROUP BY 1, 2""",
    "granted_layers": W + sql.REQ + """ SELECT user_id, string_agg(DISTINCT layer_name, ',' ORDER BY layer_name) AS layers
      FROM req WHERE request_id % 3 <> 0 GROUP BY user_id""",
    "token_checks": W + sql.REQ + """, t AS (SELECT *, CASE WHEN request_id % 6 = 2 THEN 'user-1'
          WHEN request_id % 3 < 2 THEN user_id END AS token FROM req),
      n AS (SELECT *, CASE WHEN token IS NULL THEN NULL WHEN token = '' THEN 0 ELSE CAST(substr(token, 6) AS INT) END AS i FROM t)
      SELECT request_id, token, coalesce(i % 4 <> 0 AND 1704067200 + i * 86400 > floor(epoch(time)), false) AS accepted,
        coalesce(i % 2 = 1, false) AS limited FROM n""",
}
SQL["long_catalog"] = """SELECT l_orderkey * 10 + l_linenumber AS item,
    CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN l_partkey * 7 % 20000 < 10000 THEN 'part-' || (l_partkey * 7 % 20000) END
      WHEN l_suppkey % 600 < 500 AND l_linenumber <= 4 THEN 'supplier_' || (l_suppkey % 600) END AS layer_id,
    CASE WHEN l_orderkey % 2 = 1 AND l_suppkey % 600 < 500 AND l_linenumber <= 4 THEN CAST(l_linenumber AS VARCHAR) END AS line
  FROM lineitem"""
