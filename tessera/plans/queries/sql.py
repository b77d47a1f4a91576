"""Common table expressions of the DuckDB checks."""

REQ = """req AS (
  SELECT event_id AS request_id, ts AS time,
    CASE k % 5 WHEN 0 THEN 'osm' WHEN 1 THEN 'osm-topo'
      WHEN 2 THEN concat('harbour_survey_2023090', CAST(1 + k % 2 AS VARCHAR),
                         CASE WHEN k % 3 = 0 THEN 'a' ELSE 'b' END)
      WHEN 3 THEN concat('counties_', CAST(1800 + k AS VARCHAR)) ELSE 'debug-grid' END AS layer_name,
    z, CAST((event_id * 7919 + user_id * 104729) % n AS INT) AS x,
    CAST((event_id * 6007 + user_id * 1299709) % n AS INT) AS y,
    CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('user-', CAST(user_id AS VARCHAR)) END AS user_id,
    concat('10.', CAST(user_id % 200 AS VARCHAR), '.', CAST(event_id % 250 AS VARCHAR), '.7') AS ip,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 304 ELSE 200 END AS status,
    CAST(floor(value * 10) AS BIGINT) AS duration_ms, 500 + event_id * 31 % 20000 AS bytes,
    CASE WHEN k % 5 = 3 THEN 'application/vnd.mapbox-vector-tile' ELSE 'image/png' END AS content_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k,
               CAST(event_id * 7 % 13 AS INT) AS z,
               CAST(pow(2, event_id * 7 % 13) AS BIGINT) AS n FROM events) e)"""

RES = REQ + """, res AS (
  SELECT *, CASE WHEN layer_name IN ('osm', 'osm-topo') THEN layer_name
      WHEN starts_with(layer_name, 'harbour_survey_')
        AND regexp_full_match(substr(layer_name, 16), '[0-9]{8}[ab]')
        THEN 'harbour_survey_by_date'
      WHEN starts_with(layer_name, 'counties_') AND regexp_full_match(substr(layer_name, 10), '[0-9]{4}')
        THEN 'counties_by_year'
      WHEN layer_name = 'debug-grid' THEN 'debug-grid' END AS layer_id
  FROM req)"""

EV = RES + """, ev AS (
  SELECT request_id AS event_id, time, layer_id AS layer, layer_name, z, x, y, user_id,
         duration_ms, bytes, content_type
  FROM res WHERE status IN (200, 304) AND layer_id IS NOT NULL AND layer_id <> 'debug-grid')"""


def store(every: int = 3, name: str = "store") -> str:
    return f"""{name} AS (
  SELECT layer_name, z, x, y, time AS written_at, request_id AS version,
         concat_ws('/', layer_name, z, x, y) AS content, content_type
  FROM req WHERE request_id % {every} = 0)"""


def latest(of: str = "store", name: str = "latest") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY layer_name, z, x, y
                                 ORDER BY written_at DESC, version DESC) AS rn FROM {of})
  WHERE rn = 1)"""


LOOK = RES + ", " + store() + """, look AS (
  SELECT r.*, s.layer_name IS NOT NULL AS hit
  FROM res r LEFT JOIN (SELECT DISTINCT layer_name, z, x, y FROM store) s
    USING (layer_name, z, x, y))"""

FEAT = """feat AS (
  SELECT l_orderkey * 10 + l_linenumber AS gid,
    CAST((l_orderkey * 7919 + l_linenumber * 104729) % 3600000 AS DOUBLE) / 10000.0 - 180.0 AS lon,
    CAST((l_partkey * 6007 + l_orderkey * 31) % 1700000 AS DOUBLE) / 10000.0 - 85.0 AS lat,
    l_returnflag AS kind, l_quantity AS weight FROM lineitem)"""

PI = "3.141592653589793"


def rounded(expr: str, digits: int) -> str:
    """Rounded value without a negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0 ELSE round({expr}, {digits}) END"


def lat_edge(y: str, z: str = "z") -> str:
    return f"(57.29577951308232 * atan(sinh({PI} * (1 - 2 * ({y}) / pow(2.0, {z})))))"


def lon_edge(x: str, z: str = "z") -> str:
    return f"(({x}) / pow(2.0, {z}) * 360 - 180)"


def lat_m(lat: str) -> str:
    return f"(ln(tan((90 + {lat}) * {PI} / 360)) / 0.017453292519943295 * 111319.49079327222)"


def lon_m(lon: str) -> str:
    return f"({lon} * 20037508.342789 / 180.0)"
