"""Files in and out: logs, stores, features, events."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators.vector import read_features
from tessera.plans.render import raster_build, store_audit, vector_build
from tessera.session import shared_dir
from tessera.sources import catalog as cat
from tessera.sources import events as ev
from tessera.sources import logs, sinks
from tessera.sources import store as fs
from tests.test_vector_raster import KEYS, points, tile

T0 = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def test_access_log(spark, tmp_path):
    lines = [
        '10.0.0.1 - - [05/Feb/2024:10:11:12 +0100] "GET /tiles/osm/3/4/5?key=a HTTP/1.1" 200 1234',
        '10.0.0.2 - jane doe [05/Feb/2024:10:11:12 +0000] "GET /tiles/osm/3/4/x HTTP/1.1" 400 -',
        "garbage",
        '10.0.0.3 - - [99/Feb/2024:10:11:12 +0000] "GET /tiles/osm/3/4/5 HTTP/1.1" 200 1',
        '10.0.0.4 - - [05/Feb/2024:10:11:12 +0000] "GET / HTTP/1.1" 404 19',
    ]
    (tmp_path / "access.log").write_text("\n".join(lines))
    parsed = logs.read_access_log(spark, str(tmp_path))
    good, rejects = logs.split_rejects(parsed)
    row = good.collect()
    assert len(row) == 1
    assert (row[0]["layer_name"], row[0]["z"], row[0]["x"], row[0]["y"], row[0]["bytes"]) == ("osm", 3, 4, 5, 1234)
    assert row[0]["time"] == dt.datetime(2024, 2, 5, 9, 11, 12) and row[0]["user_id"] == ""
    assert {r["value"][:8]: r["reject"] for r in rejects.collect()} == {
        "10.0.0.2": "BadRequest", "garbage": "format", "10.0.0.3": "time", "10.0.0.4": "NotFound"
    }
    with pytest.raises(ValueError):
        logs.parse_access_log(parsed.select("value"), "nope")


def test_combined_log(spark):
    line = '1.2.3.4 - u [05/Feb/2024:10:11:12 +0000] "GET /t/osm/0/0/0 HTTP/2.0" 304 0 "http://a/?q=\\"x\\"" "Agent \\\\ 1"'
    row = logs.parse_access_log(spark.createDataFrame([(line,)], "value string"), "combined").first()
    assert (row["reject"], row["referer"], row["user_agent"], row["proto"]) == (None, 'http://a/?q="x"', "Agent \\ 1", "HTTP/2.0")


def test_app_log(spark, tmp_path):
    (tmp_path / "app.json").write_text(
        '{"time":"2024-02-05T10:11:12.5Z","level":"INFO","message":"hi","uri":"/a","query":{"a":["1","2"]},"x-id":"7"}\n{broken\n'
    )
    rows = logs.read_app_log(spark, str(tmp_path), ["X-Id"]).orderBy("message").collect()
    assert rows[0]["_corrupt_record"] == "{broken"
    assert (rows[1]["message"], rows[1]["query"], rows[1]["x-id"]) == ("hi", {"a": ["1", "2"]}, "7")


def test_disk_inventory(spark, tmp_path):
    for name in ("my_layer_3_4_5", "osm_0_0_0", "notes.txt"):
        (tmp_path / name).write_bytes(b"abc")
    os.makedirs(tmp_path / "p" / "osm" / "1" / "1")
    (tmp_path / "p" / "osm" / "1" / "1" / "0").write_bytes(b"x")
    disk = fs.scan_tile_store(spark, str(tmp_path), "disk").collect()
    assert {(r["layer_name"], r["z"], r["x"], r["y"], r["bytes"]) for r in disk} == {("my_layer", 3, 4, 5, 3), ("osm", 0, 0, 0, 3)}
    objects = fs.scan_tile_store(spark, str(tmp_path), "object", with_content=True).collect()
    assert [(r["layer_name"], r["z"], r["x"], r["y"], bytes(r["content"])) for r in objects] == [("osm", 1, 1, 0, b"x")]

    key = spark.range(1).select(fs.parse_store_key(F.lit("p:a/b/1/2/3"), "redis", "p:").alias("k")).first()["k"]
    assert tuple(key) == ("a/b", 1, 2, 3)


TILES = "layer_name string, z int, x int, y int, written_at timestamp_ntz, version long, content binary, content_type string, skip_cache boolean"


def rows(*specs):
    return [("l", 1, x, 0, T0 + dt.timedelta(hours=h), v, c, "t", s) for x, h, v, c, s in specs]


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    fs.write_tile_store(spark.createDataFrame(rows((0, 0, 1, b"a", False), (0, 1, 2, b"b", False), (1, 0, 1, b"c", True)), TILES), path)
    fs.write_tile_store(spark.createDataFrame(rows((0, 2, 3, b"d", False), (2, 0, 1, b"e", None)), TILES), path)

    def contents(p):
        return {r["x"]: bytes(r["content"]) for r in fs.read_tile_store(spark, p).collect()}

    assert contents(path) == {0: b"d", 2: b"e"}
    assert fs.read_tile_store(spark, path, versions=True).count() == 3
    fs.compact_tile_store(spark, path, str(tmp_path / "small"))
    assert contents(str(tmp_path / "small")) == {0: b"d", 2: b"e"}
    assert fs.read_tile_store(spark, str(tmp_path / "small"), versions=True).count() == 2


def test_store_audit(spark):
    store = spark.createDataFrame(rows((0, 0, 1, b"a", False), (0, 1, 2, b"b", False)), TILES).drop("skip_cache")
    made = store.where("version = 2").select("layer_name", "z", "x", "y", "content", F.lit(None).cast("string").alias("error"), F.lit(True).alias("written"))
    report = store_audit(store, store.where("version = 1"), made)
    assert report["changes"].first()["change"] == "changed"
    assert report["verified"].first()["cache_read"] is True
    assert tuple(report["stats"].first()) == ("l", 1, 1, 1, 1)


def test_event_sinks(spark, tmp_path):
    events = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 1, 2, 3, 999), "main", "main", 4, 5, 6, "user-1", {"contenttype": "image/png", "bytes": "1234"}),
         (2, T0, "other", "other", 1, 1, 1, "", None)], ev.EVENT_SCHEMA)
    sinks.write_events_json(events, str(tmp_path / "json"), {"extra": "attributes"})
    got = spark.read.parquet(str(tmp_path / "json")).orderBy("layer")
    assert got.columns == ["time", "layer", "z", "x", "y", "user_id", "attributes"]
    assert [r["attributes"] for r in got.collect()] == ['{"bytes":1234,"contenttype":"image/png"}', "{}"]
    sinks.write_events_map(events, str(tmp_path / "map"))
    first = spark.read.parquet(str(tmp_path / "map")).orderBy("layer").first()
    assert first["time"] == dt.datetime(2024, 1, 1, 1, 2, 3) and first["extra"]["bytes"] == "1234"
    events.write.parquet(str(tmp_path / "events"))
    assert ev.read_tile_events(spark, str(tmp_path / "events")).count() == 2


def test_catalog_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"ord":1,"id":"b","pattern":"b{x}","rules":{"x":"1"}}\n{"ord":0,"id":"a","skip_cache":true}\n')
    first, second = cat.load_catalog(spark, str(tmp_path / "c.json"))
    assert (first.id, first.skip_cache, second.pattern, dict(second.rules)) == ("a", True, "b{x}", {"x": "1"})


def test_features_prune_and_push(spark, tmp_path):
    points(spark, [(i, float(i), 0.0, "s") for i in range(100)]).write.parquet(str(tmp_path / "f"))
    df = read_features(spark, str(tmp_path / "f"), bbox=(10.0, -1.0, 12.0, 1.0))
    assert {r["gid"] for r in df.collect()} == {10, 11, 12}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lon" in plan and "str:" not in plan.split("ReadSchema")[1]


def test_builds(spark, tmp_path):
    built = vector_build(points(spark, [(1, 1.0, 1.0, "s")]), [0, 1], str(tmp_path / "v"))
    assert built.count() == 5
    image = raster_build([tile(spark, (1, 2, 3, 255)), tile(spark, (4, 5, 6, 255))], KEYS, str(tmp_path / "r"), "add").first()
    assert (image["r"], image["b"]) == ([5] * 4, [9] * 4)


def test_shared_dir(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = shared_dir(spark, "a"), shared_dir(spark, "a")
    assert one.startswith(root) and one != two


def test_events_prune_columns(spark):
    from tessera.operators.usage import usage_by_layer_zoom
    from tessera.plans.queries.usage import events

    plan = usage_by_layer_zoom(events(spark, SF))._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "value" not in schema.split("\n")[0] and "user_id" not in schema.split("\n")[0]
    assert plan.count("Exchange hashpartitioning") == 1
