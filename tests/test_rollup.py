"""Daily states against aggregating all events, and gaps of a store against the expanded plan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.tiles import bounds
from tessera.operators import rollup as ru, usage as u
from tessera.plans import seed

EVENT = "event_id long, time timestamp_ntz, layer string, z int, x int, y int, user_id string, extra map<string,string>"


def events(spark, n, seed_=1, first=0):
    rng = random.Random(seed_)
    rows = []
    for i in range(n):
        extra = {"bytes": str(rng.randrange(9000))} | ({"duration": str(rng.randrange(500))} if rng.random() < 0.8 else {})
        day = dt.datetime(2024, 3, 1 + first + rng.randrange(3), rng.randrange(24))
        rows.append((i, day, rng.choice(["osm", "sea"]), rng.randrange(3), 0, 0, rng.choice(["", None, *"abcdefg"]), extra))
    return spark.createDataFrame(rows, EVENT)


def rows_of(df, section, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.where(F.col("section") == section).collect()), key=str)


def test_report_equals_the_operators_on_all_events(spark, tmp_path):
    target, one, two = str(tmp_path), events(spark, 300), events(spark, 200, 2, first=5)
    ru.write_days(one, target)
    ru.write_days(two, target)
    both = one.unionByName(two)
    report = ru.read_report(spark, target)
    totals = u.usage_totals(both).first()
    assert rows_of(report, "total", "tiles", "avg_duration_ms", "total_bytes") == [(500, totals["avg_duration_ms"], totals["total_bytes"])]
    by_layer = u.usage_by_layer(both).collect()
    assert rows_of(report, "layer", "layer", "tiles", "last_seen", "avg_duration_ms") == sorted(
        ((r["layer"], r["tiles"], r["last_seen"], r["avg_duration_ms"]) for r in by_layer), key=str)
    by_zoom = u.usage_by_zoom(both).collect()
    assert rows_of(report, "zoom", "z", "tiles") == [(r["z"], r["tiles"]) for r in by_zoom]
    distinct = both.where("user_id <> ''").groupBy("layer", "z").agg(F.count_distinct("user_id").alias("n")).collect()
    assert rows_of(report, "layer and zoom", "layer", "z", "users") == sorted(map(tuple, distinct), key=str)
    assert rows_of(report, "total", "users") == [(7,)]


def test_a_day_written_again_is_replaced_and_numbers_stay(spark, tmp_path):
    target, all_ = str(tmp_path), events(spark, 200)
    ru.write_days(all_, target)
    before = dict(map(tuple, ru.known_users(spark, target).collect()))
    day = dt.date(2024, 3, 2)
    again = all_.where(F.to_date("time") == F.lit(day)).limit(5).withColumn("user_id", F.lit("new"))
    ru.write_days(again, target)
    now = dict(map(tuple, ru.known_users(spark, target).collect()))
    assert {k: now[k] for k in before} == before and sorted(now.values()) == list(range(1, len(now) + 1))
    assert rows_of(ru.read_report(spark, target, day, day), "total", "tiles", "users") == [(5, 1)]
    rest = all_.where(F.to_date("time") != F.lit(day)).count()
    assert rows_of(ru.read_report(spark, target), "total", "tiles") == [(rest + 5,)]
    # Days outside are not read.
    plan = ru.read_report(spark, target, day, day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_more_users_than_a_bit_map_holds(spark, tmp_path):
    many = spark.range(70_000).select(
        F.col("id").alias("event_id"), F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz").alias("time"), F.lit("osm").alias("layer"),
        F.lit(0).alias("z"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.concat(F.lit("u"), F.col("id") % 69_000).alias("user_id"),
        F.create_map().cast("map<string,string>").alias("extra"))
    ru.write_days(many, str(tmp_path))
    assert rows_of(ru.read_report(spark, str(tmp_path)), "total", "tiles", "users") == [(70_000, 69_000)]


def regions(spark, boxes, zooms):
    df = spark.createDataFrame([(i, "l", *b) for i, b in enumerate(boxes)], "region_id long, layer_name string, s double, n double, w double, e double")
    return df.select("region_id", "layer_name", bounds(F.col("s"), F.col("n"), F.col("w"), F.col("e")).alias("area"), F.lit(zooms).alias("zooms"))


@pytest.mark.parametrize("seed_", [1, 2])
def test_gaps_equal_the_expanded_plan(spark, seed_):
    rng = random.Random(seed_)
    boxes = [(s := rng.uniform(-60, 50), s + rng.uniform(1, 9), w := rng.uniform(-170, 150), w + rng.uniform(1, 20)) for _ in range(6)]
    ranges = seed.plan_ranges(regions(spark, boxes + boxes[:1], "0-7"))
    plan = seed.expand_plan(ranges).select("layer_name", "z", "x", "y").distinct()
    tiles = [tuple(r) for r in plan.collect()]
    store = [t for t in tiles if rng.random() < 0.6] + [("l", 5, 31, 31), ("other", 3, 1, 1)]
    found = seed.missing_ranges(ranges, spark.createDataFrame(store, "layer_name string, z int, x int, y int").distinct()).collect()
    got = [(r["layer_name"], r["z"], x, r["y"]) for r in found for x in range(r["x0"], r["x1"])]
    assert sorted(got) == sorted(set(tiles) - set(store))
    starts = {(r["z"], r["y"], r["x0"]) for r in found}
    assert not any((r["z"], r["y"], r["x1"]) in starts for r in found)


def test_a_deep_plan_is_never_expanded(spark):
    """Zoom 21 over two degrees: 136 million tiles in 11 thousand rows."""
    ranges = seed.plan_ranges(regions(spark, [(10.0, 12.0, 20.0, 22.0)], "21"))
    box = ranges.first()["range"]
    store = spark.range(1000).select(
        F.lit("l").alias("layer_name"), F.lit(21).alias("z"), (F.lit(box["x0"]) + F.col("id") * 7).cast("int").alias("x"), F.lit(box["y0"]).alias("y"))
    found = seed.missing_ranges(ranges, store)
    rows = box["y1"] - box["y0"]
    assert found.count() == rows - 1 + 1000
    assert found.agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == (box["x1"] - box["x0"]) * rows - 1000


def test_shared_ranges_are_swept_once(spark):
    """Many regions over the same box cost what one costs: their ranges meet before a row of tiles appears."""
    one = regions(spark, [(10.0, 20.0, 20.0, 40.0)], "3-6")
    many = one.drop("region_id").crossJoin(spark.range(500).withColumnRenamed("id", "region_id")).select("region_id", "layer_name", "area", "zooms")
    store = seed.expand_plan(seed.plan_ranges(one)).where("(x + y) % 3 = 0").select("layer_name", "z", "x", "y").distinct()
    names = ["layer_name", "z", "y", "x0", "x1"]
    a, b = (seed.missing_ranges(seed.plan_ranges(r), store) for r in (one, many))
    assert sorted(a.select(names).collect()) == sorted(b.select(names).collect()) and a.count() > 5
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [layer_name" in line and "range#" in line for line in plan.splitlines()) == 2, "once for each use of the rows"


def test_regions_of_one_file_are_planned_by_all_cores(spark, tmp_path):
    regions(spark, [(10.0, 12.0, 20.0 + i, 22.0 + i) for i in range(200)], "3,4").coalesce(1).write.parquet(f"{tmp_path}/r")
    read = spark.read.parquet(f"{tmp_path}/r")
    spread = seed.spread_regions(read)
    assert len(spread.inputFiles()) >= spark.sparkContext.defaultParallelism > len(read.inputFiles())
    assert sorted(r[0] for r in spread.select("region_id").collect()) == list(range(200))
