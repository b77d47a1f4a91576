"""Operators against brute force and hand-made cases, hot keys included."""

import datetime as dt
import itertools
import time
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.access import ResponsePolicy
from tessera.functions.tiles import bounds, geohash_bounds
from tessera.operators import access, layers as lay, numbering as num, store as st, usage as u
from tessera.plans import seed
from tessera.plans.render import register_renderer, render, seed_run
from tessera.sources import catalog as cat
from tessera.sources import events as ev
from tessera.sources import sinks

T0 = dt.datetime(2024, 1, 1)


def log(spark, n=600, hot=0.4, seed_=1):
    """Rows (key, time, id) where one key holds a large share."""
    rng = random.Random(seed_)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(8)}"
        rows.append((key, T0 + dt.timedelta(seconds=rng.randrange(9000)), i, rng.randrange(3)))
    return rows, spark.createDataFrame(rows, "key string, time timestamp_ntz, id long, v int")


def test_chunks_fill_up(spark):
    rows, df = log(spark)
    got = {
        r["id"]: (r["chunk"], r["pos"])
        for r in num.chunk(df, ["key"], ["time", "id"], 25).collect()
    }
    for _, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        for i, r in enumerate(sorted(group, key=lambda r: (r[1], r[2]))):
            assert got[r[2]] == (i // 25, i % 25)


def test_previous_over_buckets(spark):
    rows, df = log(spark)
    out = num.with_previous(df, ["key"], ["time", "id"], F.struct("id")).collect()
    got = {r["id"]: r["previous"]["id"] if r["previous"] else None for r in out}
    for _, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        before = None
        for r in sorted(group, key=lambda r: (r[1], r[2])):
            assert got[r[2]] == before
            before = r[2]


def test_one_key_in_one_minute(spark, request):
    """All rows of one key at one time: still several ranges, and the numbers go on from range to range."""
    n = 20_000
    df = spark.range(n, numPartitions=8).select(
        F.lit("hot").alias("key"), F.lit(T0).cast("timestamp_ntz").alias("time"), (F.col("id") * 7919 % n).alias("v")
    )
    # Ranges this small would be put together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    cut = num.in_ranges(df, ["key"], ["time", "v"])
    sizes = [r["count"] for r in cut.groupBy(num.RANGE).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < n / 2
    got = num.number_rows(df, ["key"], ["time", "v"])
    assert got.where("rn <> v + 1").isEmpty() and got.count() == n
    before = num.with_previous(df, ["key"], ["time", "v"], F.struct("v"))
    assert before.where("coalesce(previous.v, -1) <> v - 1").isEmpty()
    same = num.number_rows(df.drop("v"), ["key"], ["time"])
    assert same.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn")).first() == (n, 1, n)


@pytest.mark.parametrize("limit", [5, 1, 2000])
def test_top_per_group(spark, limit):
    rows, df = log(spark)
    out = num.top_per_group(df, ["key"], ["id"], limit, F.col("id"), 4)
    want = set()
    for _, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        want |= set(sorted(r[2] for r in group)[:limit])
    assert {r["id"] for r in out.collect()} == want
    # Groups shrink before the shuffle.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert limit > 1000 or "Partial" in plan.split("WindowGroupLimit")[-1]


@pytest.mark.parametrize("ttl", [1, 60, 3600])
def test_first_fetches(spark, ttl):
    rows, df = log(spark)
    got = {(r["key"], r["fetched_at"]) for r in st.first_fetches(df, ttl, ["key"]).collect()}
    want, free = set(), {}
    for key, time, _, _ in sorted(rows, key=lambda r: r[1]):
        at = int(time.replace(tzinfo=dt.timezone.utc).timestamp())
        if at >= free.get(key, 0):
            want.add((key, at))
            free[key] = at + ttl
    assert got == want


def test_first_fetches_small_batches(spark):
    rows, df = log(spark, 300)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {tuple(r) for r in st.first_fetches(df, 600, ["key"]).collect()}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert {tuple(r) for r in st.first_fetches(df, 600, ["key"]).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def tiles(spark, rows):
    return spark.createDataFrame(rows, "z int, x int, y int, content string, error string")


@pytest.mark.parametrize(
    "mode,failed,zoom_ok,source,skip",
    [
        (mode, failed, zoom_ok, "primary" if zoom_ok and not failed else "secondary",
         {"always": False, "unless-error": zoom_ok and failed, "unless-fallback": not zoom_ok or failed}[mode])
        for mode in st.CACHE_MODES for failed in (True, False) for zoom_ok in (True, False)
    ],
)
def test_fallback_matrix(spark, mode, failed, zoom_ok, source, skip):
    key = spark.createDataFrame([(20, 1, 1)], "z int, x int, y int")
    primary = tiles(spark, [(20, 1, 1, "p", "bad" if failed else None)])
    secondary = tiles(spark, [(20, 1, 1, "s", None)])
    row = st.fallback(key, primary, secondary, F.lit(zoom_ok), F.lit(True), mode).first()
    assert (row["source"], row["skip_cache"], row["error"]) == (source, skip, None)
    assert row["content"] == source[0]


def test_fallback_without_any_tile(spark):
    key = spark.createDataFrame([(1, 1, 1)], "z int, x int, y int")
    none = tiles(spark, [(9, 1, 1, "s", None)])
    assert st.fallback(key, none, none, F.lit(True), F.lit(True)).first()["error"] == "no tile"
    with pytest.raises(ValueError):
        st.fallback(key, none, none, F.lit(True), F.lit(True), "sometimes")


def test_resolution_order_and_long_catalogs(spark):
    layers = [cat.Layer("first", "a{x}"), cat.Layer("second", "ab{x}"), cat.Layer("ab")]
    names = spark.createDataFrame([("abc",), ("ab",), ("zz",), (None,)], "layer_name string")

    def ids():
        return {r["layer_name"]: (r["layer_id"], r["layer_params"]) for r in lay.resolve_layers(names, layers).collect()}

    inline = ids()
    assert inline["abc"] == ("first", {"x": "bc"}) and inline["zz"] == (None, None) and inline[None][0] is None
    layers += [cat.Layer(f"n{i}") for i in range(10_000)] + [cat.Layer(f"p{i}", f"p{i}-{{x}}") for i in range(500)]
    start = time.perf_counter()
    out = lay.resolve_layers(names.unionByName(spark.createDataFrame([("n9999",), ("p499-q",), ("p49-",)], "layer_name string")), layers)
    out._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - start < 10
    got = {r["layer_name"]: (r["layer_id"], r["layer_params"]) for r in out.collect()}
    assert got["n9999"] == ("n9999", {}) and got["p499-q"] == ("p499", {"x": "q"}) and got["p49-"] == ("p49", {"x": ""})
    assert {k: got[k] for k in inline} == inline


def test_catalog_rejects_duplicates(spark):
    with pytest.raises(ValueError, match="duplicate"):
        cat.check_catalog([cat.Layer("a"), cat.Layer("a")])
    assert cat.catalog_frame(spark, [cat.Layer("a"), cat.Layer("b", "b{x}")]).count() == 2


def test_reference_hops(spark):
    chain = {f"l{i}": {"name": "ref", "layer": f"l{i + 1}"} for i in range(13)}
    reach = lay.reference_closure(cat.reference_edges(spark, chain)).where("layer = 'l0'").collect()
    assert {(r["target"], r["hops"]) for r in reach} == {(f"l{i}", i) for i in range(1, 12)}
    assert {r["hops"] for r in reach if r["error"]} == {11}
    ring = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", "a", 1)], "layer string, target string, times int")
    out = {(r["layer"], r["target"], r["hops"]): (r["times"], r["error"]) for r in lay.reference_closure(ring, 4).collect()}
    assert out["a", "a", 2] == (2, "a layer refers to itself") and out["c", "b", 2] == (1, None)
    assert out["a", "a", 4][0] == 4 and out["c", "a", 5] == (4, "more than 4 references in a row")
    wide = spark.createDataFrame([("a", x, 1) for x in "bc"] + [(x, "d", 3) for x in "bc"], "layer string, target string, times int")
    assert {(r["layer"], r["target"]): r["times"] for r in lay.reference_closure(wide).collect()}["a", "d"] == 6


def test_policy_merge(spark):
    layers = [cat.Layer("a", client=ResponsePolicy((), ("x/y",), 0, False, {}))]
    df = spark.createDataFrame([("a",), ("b",)], "layer_id string")
    got = {
        r["layer_id"]: r["policy"]
        for r in lay.with_policy(df, layers, ResponsePolicy(max_length=5, unknown_length=True)).collect()
    }
    assert got["a"]["content_types"] == ["x/y"] and got["a"]["max_length"] == 5
    assert got["a"]["statuses"] == [200] and got["a"]["unknown_length"] is False
    assert got["b"]["unknown_length"] is True


def test_empty_totals(spark):
    none = spark.createDataFrame([], ev.EVENT_SCHEMA)
    assert tuple(u.usage_totals(none).first()) == (0, 0, 0, 0)
    assert u.usage_by_layer(none).count() == 0


def test_average_rounds_half_away(spark):
    rows = [(i, T0, "l", "l", 0, 0, 0, "", {"duration": d}) for i, d in enumerate(("2", "3"))]
    assert u.usage_totals(spark.createDataFrame(rows, ev.EVENT_SCHEMA)).first()["avg_duration_ms"] == 3
    odd = [(0, T0, "l", "l", 0, 0, 0, "", {"duration": "n/a"})]
    assert u.usage_totals(spark.createDataFrame(odd, ev.EVENT_SCHEMA)).first()["avg_duration_ms"] == 0


def test_fields(spark):
    df = spark.createDataFrame(
        [("osm", "1.2.3.4", {"User-Agent": "ua"}, None)], "layer_name string, ip string, headers map<string,string>, host string"
    )
    got = df.select(
        ev.resolve_fields(df, ["IP", "useragent", "referer", "host"], {"t": "const", "h": "hdr.user-agent", "ip": "x"}).alias("e")
    ).first()["e"]
    assert got == {"ip": "x", "useragent": "ua", "t": "const", "h": "ua"}
    assert df.select(ev.resolve_fields(df).alias("e")).first()["e"] is None
    with pytest.raises(ValueError):
        ev.resolve_fields(df, ["nope"])


def test_sink_columns():
    assert sinks.sink_columns({"layer": "my_layer"})["layer"] == "my_layer"
    for bad in ({"nope": "x"}, {"layer": "a b"}, {"layer": "1x"}):
        with pytest.raises(ValueError):
            sinks.sink_columns(bad)


def test_payload_sizes(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i), "l", "l", 1, 2, 3, "u", {"z": "9"}) for i in range(30)]
    rows.append((99, T0, "l", "l", 1, 2, 3, "", None))
    out = sinks.ga_payloads(spark.createDataFrame(rows, ev.EVENT_SCHEMA)).collect()
    sizes = sorted((r["client_id"], r["chunk"], r["n"]) for r in out)
    assert sizes == [("anonymous", 0, 1), ("u", 0, 25), ("u", 1, 5)]
    first = next(r["payload"] for r in out if r["n"] == 5)
    assert first.startswith('{"client_id":"u","user_id":"u","events":[{"name":"tile_request","params":{"layer":"l","x":2,"y":3,"z":"9"}}')
    anonymous = next(r["payload"] for r in out if r["n"] == 1)
    assert anonymous == '{"client_id":"anonymous","events":[{"name":"tile_request","params":{"layer":"l","x":2,"y":3,"z":1}}]}'


def test_daily_report(spark):
    from tessera.plans.queries import usage as q
    from tessera.plans.render import daily_report

    sf = "/root/testdata/sf0.001"
    events, looked = q.events(spark, sf), q.lookups(spark, sf)
    served = looked.where("status <> 500").withColumn("layer", F.col("layer_id"))
    report = daily_report(events, looked, u.classify_errors(looked), served)
    assert report["totals"].first()["tiles"] == events.count()
    counters = {r["metric"]: r["value"] for r in report["counters"].collect()}
    assert counters["cache.total.hit"] + counters["cache.total.miss"] == counters["tiles.total.valid"] == looked.count()
    assert {r["verdict"] for r in report["reconciliation"].collect()} == {"same", "unrecorded"}
    empty = u.service_counters(looked.limit(0)).collect()
    assert {r["value"] for r in empty} == {0} and len(empty) == 6


def test_audit_anonymous_is_open(spark):
    rows = [(1, "osm", "", 10, 10, 10), (2, "osm", "u", 10, 10, 10), (3, "osm", "u", 0, 0, 0), (4, None, "", 0, 0, 0)]
    requests = spark.createDataFrame(rows, "request_id long, layer_id string, user_id string, z int, x int, y int")
    grant = spark.range(1).select(
        F.lit("u").alias("user_id"), F.lit(False).alias("limit_layers"), F.array().cast("array<string>").alias("allowed_layers"),
        geohash_bounds(F.lit("gb")).alias("area"), F.lit(True).alias("partial"),
    )
    got = {r["request_id"]: r["verdict"] for r in access.audit(requests, grant).collect()}
    assert got == {1: "ok", 2: "area", 3: "ok", 4: "unknown"}


# -- seed plans ---------------------------------------------------------------

def region(spark, s, n, w, e, zooms, id_=1):
    return spark.range(1).select(
        F.lit(id_).alias("region_id"), F.lit("l").alias("layer_name"), bounds(s, n, w, e).alias("area"),
        F.lit(zooms).alias("zooms"),
    )


def cover(spark, *box, zooms, **kw):
    rows = seed.expand_plan(seed.plan_ranges(region(spark, *box, zooms), kw.pop("strict", False)), **kw)
    return sorted((r["z"], r["x"], r["y"]) for r in rows.collect())


def test_world_cover(spark):
    world = (-90.0, 90.0, -180.0, 180.0)
    assert cover(spark, *world, zooms="0") == [(0, 0, 0)]
    assert len(cover(spark, *world, zooms="1")) == 4
    assert len(cover(spark, *world, zooms="1,1")) == 8
    assert len(cover(spark, *world, zooms="5", spread=True)) == 1024


def test_cover_edge_cases(spark):
    assert cover(spark, 51.0, 51.6, 5.7, 7.0, zooms="8") == [(8, 132, 85)]
    # The partial easternmost column is left out, unless strict.
    assert {x for _, x, _ in cover(spark, 51.0, 51.6, 5.7, 8.0, zooms="8")} == {132}
    assert {x for _, x, _ in cover(spark, 51.0, 51.6, 5.7, 8.0, zooms="8", strict=True)} == {132, 133}
    assert {x for _, x, _ in cover(spark, 0.0, 1.0, 180.0, 180.0, zooms="3")} == {8}
    assert {x for _, x, _ in cover(spark, 0.0, 1.0, 180.0, 180.0, zooms="3", strict=True)} == {7}
    # A box over the date line breaks the limit; strict mode splits it.
    bad = seed.plan_guards(region(spark, 0.0, 1.0, 170.0, 190.0, "3"), force=True).first()
    assert bad["error"] == "too many tiles in a zoom"
    assert {x for _, x, _ in cover(spark, 0.0, 1.0, 170.0, -170.0, zooms="4", strict=True)} == {0, 15}


def test_limits(spark):
    world = (-85.0, 85.0, -180.0, 180.0)

    def error(zooms, force=False):
        return seed.plan_guards(region(spark, *world, zooms), force).first()["error"]

    assert error("0-6") is None
    assert error("7") == "too many tiles in a zoom"
    assert error("7", True) is None
    assert error("7,7,7,7,7", True) == "too many tiles in a run"
    assert error("21", True) == "too many tiles in a zoom"
    assert error("3-2") == "bad zooms"
    assert error("6,6,6,1") == "too many tiles in a zoom"
    with pytest.raises(seed.SeedLimitError, match="1 regions break a limit: 1 with too many tiles in a zoom") as told:
        seed.seed_plan(region(spark, *world, "9"))
    assert told.value.rejected.count() == 1
    assert seed.seed_plan(region(spark, *world, "9"), on_limit="report").count() == 0


def test_seed_run(spark, tmp_path):
    from tessera.sources.store import read_tile_store

    def fn(layer, z, x, y, params):
        if x == 1:
            raise OSError("upstream")
        return f"{z}/{x}/{y}".encode(), "image/png"

    register_renderer("test", fn)
    held = spark.createDataFrame(
        [("l", 1, 0, 0, T0, 1, b"old", "image/png")],
        "layer_name string, z int, x int, y int, written_at timestamp_ntz, version long, content binary, content_type string",
    )
    now = T0 + dt.timedelta(hours=1)
    summary = seed_run(region(spark, -80.0, 80.0, -180.0, 180.0, "1"), held, "test", str(tmp_path / "out"), now)
    assert [tuple(r) for r in summary.collect()] == [("l", 1, 3, 1, 2, 0)]
    far = region(spark, -85.0, 85.0, -180.0, 180.0, "9")
    with pytest.raises(seed.SeedLimitError):
        seed_run(far, held, "test", str(tmp_path / "out"), now)
    told = seed_run(far, held, "test", str(tmp_path / "out"), now, on_limit="report")
    assert [tuple(r) for r in told.collect()] == [("l", None, 0, 0, 0, 1)]
    assert len(list((tmp_path / "out" / "results").glob("run=*"))) == 2
    stored = read_tile_store(spark, str(tmp_path / "out" / "tiles"))
    assert {(r["x"], r["y"]) for r in stored.collect()} == {(0, 1)}
    none = render(spark.createDataFrame([("l", 0, 1, 0)], "layer_name string, z int, x int, y int"), "test").first()
    assert none["error"] == "OSError: upstream"


def test_same_needs_an_earlier_tile(spark):
    schema = "layer_name string, z int, x int, y int, content binary, content_type string"
    now = spark.createDataFrame([("l", 1, x, 0, b"a", "t") for x in range(3)], schema)
    before = spark.createDataFrame([("l", 1, 0, 0, b"a", "t"), ("l", 1, 1, 0, b"b", "t")], schema)
    asked = now.select("layer_name", "z", "x", "y").withColumns({"validation": F.lit("same"), "expected": F.lit(None).cast("string")})
    told = {r["x"]: r["error"] for r in st.validate_tiles(now, asked, before).collect()}
    assert told == {0: None, 1: "result changed", 2: "no previous tile"}
    assert {r["error"] for r in st.validate_tiles(now, asked).collect()} == {"no previous tile"}


def test_store_listing_and_boxes_of_geometries(spark, tmp_path):
    from tessera.operators.vector import read_features
    from tessera.sources.store import list_tile_store

    keys = spark.createDataFrame([("p/a/1/0/1", 5), ("other", 6), ("p/b/c/2/3/1", 7)], "key string, size int")
    found = list_tile_store(keys, "object", "p/").collect()
    assert {(r["layer_name"], r["z"], r["x"], r["y"], r["size"]) for r in found} >= {("a", 1, 0, 1, 5)} and len(found) <= 2
    geoms = [(1, ("line", [(0.0, 0.0), (5.0, 5.0)])), (2, ("line", [(7.0, 7.0), (9.0, 9.0)]))]
    frame = spark.createDataFrame(geoms, "gid long, geom struct<kind:string,coords:array<struct<x:double,y:double>>>")
    frame.write.parquet(str(tmp_path / "g"))
    kept = read_features(spark, str(tmp_path / "g"), geometry=["geom"], bbox=(4.0, 4.0, 6.0, 6.0)).collect()
    assert [r["gid"] for r in kept] == [1]
