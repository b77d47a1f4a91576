"""Streams give the batch result however the input is cut."""

import datetime as dt
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.keys import etag
from tessera.operators.store import TILE as KEYS, change_points, first_fetches
from tessera.plans.queries.stream import finish
from tessera.sources import derived as d
from tessera.sources.events import to_tile_events
from tessera.streaming import delivery, ingest, stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_requests(spark, tmp_path_factory):
    """The request log in seven files by time; one file per micro-batch."""
    path = str(tmp_path_factory.mktemp("requests"))
    requests = d.tile_requests(spark, SF)
    # A hot tile: a third of all requests.
    requests = requests.withColumns({c: F.when(F.col("request_id") % 3 == 0, 0).otherwise(F.col(c)) for c in "zxy"})
    requests = requests.withColumn("layer_name", F.when(F.col("request_id") % 3 == 0, F.lit("osm")).otherwise(F.col("layer_name")))
    for part in range(7):
        requests.where(F.floor(F.dayofmonth("time") / 5) == part).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def stream(spark, split_requests):
    path, table = split_requests
    return ingest.read_stream(spark, path, table.schema, files_per_trigger=1)


def drain(df, tmp_path):
    finish(ingest.append_stream(df, f"{tmp_path}/rows", f"{tmp_path}/checkpoint", available_now=True))
    return df.sparkSession.read.parquet(f"{tmp_path}/rows")


def test_fetches_do_not_depend_on_batches(spark, split_requests, tmp_path):
    rows = drain(stateful.fetch_stream(stream(spark, split_requests), 86_400), tmp_path)
    want = first_fetches(split_requests[1], 86_400)
    assert rows.exceptAll(want).count() == 0 and want.exceptAll(rows).count() == 0


def test_alerts_match_batch(spark, split_requests, tmp_path):
    def observed(requests):
        changing = F.concat(F.lit("v"), F.floor(F.col("request_id") / 50))
        return requests.select(
            *"layer_name z x y".split(), F.col("time").alias("written_at"), F.col("request_id").alias("version"),
            changing.cast("binary").alias("content"), "content_type")

    rows = drain(stateful.change_stream(observed(stream(spark, split_requests))), tmp_path)
    want = change_points(observed(split_requests[1]))
    names = ["layer_name", "z", "x", "y", "version", "etag", "previous_etag"]
    assert want.count() > 10
    assert rows.select(names).exceptAll(want.select(names)).count() == 0
    assert want.select(names).exceptAll(rows.select(names)).count() == 0


def test_fetches_go_on_after_a_restart(spark, split_requests, tmp_path):
    """Stopped after some files and started again, from a state that is read back in between."""
    path, table = split_requests
    files = sorted(os.listdir(path))
    files = sorted((f for f in files if f.endswith(".parquet")), key=lambda f: spark.read.parquet(f"{path}/{f}").agg(F.min("time")).first()[0])
    half = tmp_path / "half"
    half.mkdir()
    want = first_fetches(table, 86_400)
    for part in (files[:4], files[4:]):
        for f in part:
            shutil.copy(f"{path}/{f}", half / f)
            os.utime(half / f, (files.index(f) + 1e9, files.index(f) + 1e9))
        rows = drain(stateful.fetch_stream(ingest.read_stream(spark, str(half), table.schema, files_per_trigger=1), 86_400), tmp_path)
        state = spark.read.format("statestore").option("stateVarName", "free_at").load(f"{tmp_path}/checkpoint")
        held = state.select("key.*", F.col("value.free_at").alias("free_at"))
        last = rows.groupBy(*KEYS).agg((F.max("fetched_at") + 86_400).alias("free_at"))
        # What has been held is the last fetch of its tile; copies that ran out are gone.
        assert 0 < held.count() <= last.count() and held.exceptAll(last).isEmpty()
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
    assert held.count() < last.count()


def test_state_starts_from_a_batch_table(spark, split_requests, tmp_path):
    path, table = split_requests
    day = F.dayofmonth("time")
    early, late = table.where(day < 15), table.where(day >= 15)
    late.write.parquet(f"{tmp_path}/late")
    known = first_fetches(early, 86_400).groupBy(*KEYS).agg(F.max("fetched_at").alias("fetched_at"))
    source = ingest.read_stream(spark, f"{tmp_path}/late", table.schema)
    got = drain(stateful.fetch_stream(source, 86_400, initial=known), tmp_path)
    first_late = late.agg(F.min(F.unix_timestamp(F.col("time").cast("timestamp")))).first()[0]
    want = first_fetches(table, 86_400).where(F.col("fetched_at") >= first_late)
    assert want.count() > 10 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_alerts_start_from_a_batch_table(spark, tmp_path):
    kind = "layer_name string, z int, x int, y int, written_at timestamp_ntz, version long, content binary, content_type string"
    now = dt.datetime(2024, 1, 1)
    rows = [("a", 0, 0, 0, now, 1, b"new", "t"), ("b", 0, 0, 0, now, 1, b"same", "t"), ("c", 0, 0, 0, now, 1, b"x", None), ("d", 0, 0, 0, None, None, b"x", "t")]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/seen")
    tag = spark.range(1).select(etag(F.lit(b"same")).alias("e")).first()["e"]
    before = [(n, 0, 0, 0, tag if n == "b" else "old", "t") for n in "ab"]
    initial = spark.createDataFrame(before, "layer_name string, z int, x int, y int, etag string, content_type string")
    source = ingest.read_stream(spark, f"{tmp_path}/seen", spark.read.parquet(f"{tmp_path}/seen").schema)
    got = drain(stateful.change_stream(source, initial=initial), tmp_path).collect()
    assert [(r["layer_name"], r["previous_etag"]) for r in got] == [("a", "old")]


def test_ingest_resumes_without_doubles(spark, split_requests, tmp_path):
    target, checkpoint = f"{tmp_path}/events", f"{tmp_path}/cp"
    for _ in range(2):
        finish(ingest.ingest_events(stream(spark, split_requests), d.LAYERS, target, checkpoint, max_size=50, available_now=True))
    want = to_tile_events(split_requests[1], d.LAYERS)
    got = spark.read.parquet(target)
    assert got.count() == got.select("event_id").distinct().count() == want.count()
    sizes = got.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert sizes <= 50


def test_dashboard_after_many_batches(spark, split_requests, tmp_path):
    from tessera.operators.usage import usage_totals

    events = to_tile_events(stream(spark, split_requests), d.LAYERS)
    finish(ingest.live_dashboard(events, f"{tmp_path}/v", f"{tmp_path}/cp", available_now=True))
    want = usage_totals(to_tile_events(split_requests[1], d.LAYERS)).first()
    assert ingest.read_view(spark, f"{tmp_path}/v", "totals").first() == want


def run_batches(df, deliver, checkpoint):
    query = df.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finish(query)


def test_strict_fan_out_retries_only_the_failed_sink(spark, split_requests, tmp_path):
    calls = {"good": 0, "flaky": 0}

    def good(batch, batch_id):
        calls["good"] += 1
        batch.select("request_id").write.mode("overwrite").parquet(f"{tmp_path}/good/batch_id={batch_id}")

    def flaky(batch, batch_id):
        calls["flaky"] += 1
        if calls["flaky"] == 2:
            raise OSError("down")
        batch.select("request_id").write.mode("overwrite").parquet(f"{tmp_path}/flaky/batch_id={batch_id}")

    deliver = delivery.fan_out({"good": good, "flaky": flaky}, f"{tmp_path}/log")
    source = stream(spark, split_requests)
    with pytest.raises(Exception, match="down"):
        run_batches(source, deliver, f"{tmp_path}/cp")
    run_batches(source, deliver, f"{tmp_path}/cp")
    n = split_requests[1].count()
    assert spark.read.parquet(f"{tmp_path}/good").count() == spark.read.parquet(f"{tmp_path}/flaky").count() == n
    # The batch that failed at one sink was not written again at the other.
    assert calls["good"] == calls["flaky"] - 1
    log = delivery.read_log(spark, f"{tmp_path}/log").groupBy("sink").agg(
        F.sum(F.when(F.col("error").isNull(), F.col("n"))).alias("n"), F.count("error").alias("errors"))
    assert {r["sink"]: (r["n"], r["errors"]) for r in log.collect()} == {"good": (n, 0), "flaky": (n, 1)}


def test_containment_needs_a_place(spark):
    with pytest.raises(ValueError):
        delivery.fan_out({}, "log", strict=False)


def test_listener_counts(spark, split_requests, tmp_path):
    listener = delivery.DeliveryListener()
    spark.streams.addListener(listener)
    try:
        observed = delivery.observed(stream(spark, split_requests).select("request_id"))
        query = observed.writeStream.format("parquet").queryName("counted").option("path", f"{tmp_path}/o").option(
            "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        finish(query)
        for _ in range(50):
            if listener.counts.get("counted") == 1000:
                break
            time.sleep(0.2)
        assert listener.counts["counted"] == 1000
    finally:
        spark.streams.removeListener(listener)


def test_a_recorder_counts_a_replayed_batch_once(spark, split_requests, tmp_path):
    calls = []

    def recorder(batch, params, batch_id):
        calls.append(batch_id)
        batch.select("request_id").write.mode("overwrite").parquet(f"{params['path']}/batch_id={batch_id}")
        if len(calls) == 3:
            raise OSError("after the write")

    def run():
        finish(
            ingest.record_with(
                stream(spark, split_requests), recorder, {"path": f"{tmp_path}/rows"}, f"{tmp_path}/cp", available_now=True
            )
        )

    with pytest.raises(Exception, match="after the write"):
        run()
    run()
    assert calls.count(calls[2]) == 2 and len(set(calls)) == 7
    assert spark.read.parquet(f"{tmp_path}/rows").count() == split_requests[1].count()


def test_alerts_of_one_block_share_a_value(spark, tmp_path):
    """Tiles of a block keep their own order and baseline, over batches, beside an initial state and with null keys."""
    kind = "layer_name string, z int, x int, y int, written_at timestamp_ntz, version long, content binary, content_type string"
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(3)]
    path = tmp_path / "seen"
    tiles = [("a", 9, x, y) for x in (0, 1, 15, 16, None) for y in (0, 17)] + [(None, 9, 1, 0)]
    for i, time_ in enumerate(at):
        rows = [(*t, time_, i, b"%d" % (0 if t[2] == 1 else i), "t") for t in tiles]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(path))
    tag = spark.range(1).select(etag(F.lit(b"0")).alias("e")).first()["e"]
    before = [("a", 9, 15, 0, tag, "t"), ("a", 9, 15, 17, "old", None), ("a", 9, 14, 0, "old", "t")]
    initial = spark.createDataFrame(before, "layer_name string, z int, x int, y int, etag string, content_type string")
    source = ingest.read_stream(spark, str(path), spark.read.parquet(str(path)).schema, files_per_trigger=1)
    got = drain(stateful.change_stream(source, initial=initial), tmp_path).collect()
    want = {(*t, i) for t in tiles for i in (1, 2) if t[2] != 1} | {("a", 9, 15, 17, 0)}
    assert len(got) == len(want) and {(r["layer_name"], r["z"], r["x"], r["y"], r["version"]) for r in got} == want
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/checkpoint")
    held = state.select("key.*", F.explode(F.arrays_zip("value.x", "value.y")).alias("t"))
    assert state.count() < len(tiles) and held.count() == len(tiles) + 1


def test_fetches_of_one_bucket_share_a_value(spark, tmp_path):
    """Tiles of a bucket keep their own ends, over batches, beside an initial state and with null keys; what ran out goes."""
    kind = "layer_name string, z int, x int, y int, time timestamp_ntz"
    now, day = dt.datetime(2024, 1, 10), dt.timedelta(days=1)
    tiles = [("a", 9, x, y) for x in (0, 1, 15, None) for y in (0, 17)] + [(None, 9, 1, 0)]
    # The last request of each tile: the first tile's copy holds, each other one's runs out on a day of its own.
    steps = [[(*t, now + i * day / 2) for t in tiles] for i in range(3)]
    steps += [[(*tiles[0], now + 9 * day + i * day / 48) for i in range(40)] + [(*tiles[1], None)], [(*tiles[0], now + 10 * day)]]
    path = tmp_path / "seen"
    for rows in steps:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(path))
    table = spark.read.parquet(str(path))
    before = [(*tiles[1], 1704801600), (*tiles[2], 1704000000), ("z", 9, 0, 0, 1704801600)]  # Jan 9 12:00, Dec 31, Jan 9 12:00
    initial = spark.createDataFrame(before, "layer_name string, z int, x int, y int, fetched_at long")
    source = ingest.read_stream(spark, str(path), table.schema, files_per_trigger=1)
    got = drain(stateful.fetch_stream(source, 86_400, initial=initial, buckets=2), tmp_path)
    earlier = spark.createDataFrame([(*r[:4], dt.datetime(1970, 1, 1) + dt.timedelta(seconds=r[4])) for r in before], kind)
    named = {"layer_name": "none", "x": -1}  # the batch operator tells rows with null keys apart
    want = first_fetches(table.where("time is not null").unionByName(earlier).na.fill(named), 86_400).where("fetched_at >= 1704844800")
    got = got.na.fill(named)
    assert want.count() == 19 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    state = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/checkpoint")
    held = state.select(F.explode(F.arrays_zip("value.layer_name", "value.z", "value.x", "value.y", "value.free_at")).alias("t")).select("t.*")
    assert [tuple(r) for r in held.collect()] == [(*tiles[0], 1704844800 + 11 * 86_400)]
    first = spark.read.format("statestore").option("stateVarName", "held").option("batchId", 1).load(f"{tmp_path}/checkpoint")
    assert 0 < first.count() <= 2 and first.select(F.explode("value.free_at")).count() >= len(tiles)


def test_the_query_of_fetches_shares_values(spark, tmp_path, monkeypatch):
    """As many state values as buckets, however many tiles."""
    from tessera.plans.queries import stream as queries

    place = str(tmp_path / "out")
    monkeypatch.setattr(queries, "shared_dir", lambda *_: place)
    monkeypatch.setattr(stateful, "BUCKETS", 3)
    rows = queries.fetch_stream(spark, SF)
    want = first_fetches(d.tile_requests(spark, SF), stateful.TTL_KEY_VALUE)
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
    state = spark.read.format("statestore").option("batchId", 0).option("stateVarName", "held").load(f"{place}/checkpoint")
    assert state.count() == 3 and state.agg(F.sum(F.size("value.free_at"))).first()[0] > 100
