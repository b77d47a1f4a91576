"""Keyed streaming state: upstream fetches under a lifetime, change alerts.

Both are stateful processors with one small value per tile, or per block or bucket of tiles, kept in RocksDB, so
state may outgrow memory and a micro-batch touches only the tiles, blocks or buckets that it has rows for.  The values
can start from a batch table, and be read with Spark's ``statestore`` source.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.keys import etag
from tessera.operators.store import TILE

# Lifetimes of the in-process and the key-value stores, seconds.
TTL_MEMORY = 3600
TTL_KEY_VALUE = 86_400

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(
    rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: T.StructType, time_mode: str, initial: DataFrame | None
) -> DataFrame:
    """Rows through a processor; sets the session's state store, which these processors need."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    start = None if initial is None else initial.groupBy(*keys)
    return rows.groupBy(*keys).transformWithState(processor, schema, "Append", time_mode, start)


class Fetches(StatefulProcessor):
    """Emits the seconds at which a tile is fetched; the state is when its copy runs out."""

    def __init__(self, keys: Sequence[str], ttl_seconds: int):
        self.row, self.ttl = Row(*keys, "fetched_at"), ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free_at = handle.getValueState("free_at", T.StructType([T.StructField("free_at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Distinct seconds only: small however hot the tile is.
        seconds = sorted({row["fetched_at"] for row in rows} - {None})
        known = self.free_at.get()
        free_at = before = known[0] if known else -sys.maxsize
        for second in seconds:
            if second >= free_at:
                free_at = second + self.ttl
                yield self.row(*key, second)
        if free_at != before:
            self.free_at.update((free_at,))
            if not known:
                self._expire(free_at, timerValues)

    def _expire(self, free_at: int, timerValues) -> None:
        """One timer per tile; it is set again where the copy has been renewed meanwhile."""
        self.handle.registerTimer(max(free_at * 1000, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.free_at.get()
        if known and known[0] * 1000 > timerValues.getCurrentWatermarkInMs():
            self._expire(known[0], timerValues)
        else:
            self.free_at.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        free_at = initialState["fetched_at"] + self.ttl
        self.free_at.update((free_at,))
        self._expire(free_at, timerValues)

    def close(self) -> None:
        pass


#: Buckets of tiles of a large fetch stream.
BUCKETS = 1 << 14


class BucketFetches(StatefulProcessor):
    """``Fetches`` with one value per bucket of tiles; the state is when the copies of its tiles run out.

    Every key, value and timer is a round trip to the worker, so there are as many as buckets, not tiles.
    A value has an array per key column and one of ends.  Its timer is that of the copy that runs out first.
    """

    def __init__(self, keys: T.StructType, ttl_seconds: int):
        self.keys, self.ttl = keys.names, ttl_seconds
        self.state = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in (*keys, T.StructField("free_at", T.LongType()))])
        self.row = Row(*self.keys, "fetched_at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen: dict[tuple, set[int]] = {}
        for row in rows:
            if row["fetched_at"] is not None:
                seen.setdefault(tuple(row[c] for c in self.keys), set()).add(row["fetched_at"])
        known = self._held()
        held, changed = dict(known), False
        for tile, seconds in seen.items():
            free_at = held.get(tile, -sys.maxsize)
            for second in sorted(seconds):
                if second >= free_at:
                    held[tile] = free_at = second + self.ttl
                    changed = True
                    yield self.row(*tile, second)
        if changed:
            self._keep(held, timerValues, bool(known))

    def _held(self) -> dict[tuple, int]:
        return {tuple(v[:-1]): v[-1] for v in zip(*(self.held.get() or ()))}

    def _keep(self, held: dict[tuple, int], timerValues, timed: bool) -> None:
        """Write what has not run out; ``timed`` if a timer is set already, which then sets the next."""
        watermark = timerValues.getCurrentWatermarkInMs()
        left = [(*tile, free_at) for tile, free_at in held.items() if free_at * 1000 > watermark]
        if not left:
            self.held.clear()
            return
        self.held.update(tuple(list(c) for c in zip(*left)))
        if not timed:
            self.handle.registerTimer(min(v[-1] for v in left) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._keep(self._held(), timerValues, False)
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep({tuple(r[c] for c in self.keys): r["fetched_at"] + self.ttl for r in initialState["tiles"]}, timerValues, False)

    def close(self) -> None:
        pass


def _output(df: DataFrame, names: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in names), *more])


def fetch_stream(
    requests: DataFrame,
    ttl_seconds: int = TTL_MEMORY,
    lateness: str = "1 hour",
    keys: Sequence[str] = TILE,
    time: str = "time",
    initial: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Requests that reach the upstream, per tile, as in ``first_fetches``.

    The state is one number per tile: when its copy runs out.  Inside a
    micro-batch a tile's requests are taken in event-time order, so the result
    does not depend on where batches are cut as long as files arrive in time
    order.  A timer removes the state once the watermark has passed it.  ``initial``
    has each tile's last ``fetched_at`` from before, at most one row a tile.  With
    ``buckets`` tiles share that many state values, by their hash; a stream keeps its number.
    """
    timed = requests.select(
        *keys,
        F.col(time).cast("timestamp").alias("_t"),
        F.unix_timestamp(F.col(time).cast("timestamp")).alias("fetched_at"),
    ).withWatermark("_t", lateness)
    schema = _output(timed, [*keys, "fetched_at"])
    if buckets is None:
        return _stateful(timed, keys, Fetches(keys, ttl_seconds), schema, "EventTime", initial)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    if initial is not None:
        initial = initial.groupBy(bucket).agg(F.collect_list(F.struct(*keys, "fetched_at")).alias("tiles"))
    processor = BucketFetches(_output(timed, keys), ttl_seconds)
    return _stateful(timed.select("*", bucket), ["_bucket"], processor, schema, "EventTime", initial)


#: Blocks of 2**BLOCK_SHIFT by as many tiles share one value of a change stream.
BLOCK_SHIFT = 4


class Changes(StatefulProcessor):
    """Emits observations that differ from the one before; the state is the last tag and type of a block's tiles.

    Every value read or written is a round trip to the worker, so a block of 16 x 16 tiles has one value:
    an array per key column, and one each of tags and types.
    """

    COLUMNS = ("written_at", "version", "etag", "content_type")

    def __init__(self, keys: T.StructType):
        self.keys = keys.names
        texts = [T.StructField(c, T.StringType()) for c in ("etag", "content_type")]
        self.state = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in (*keys, *texts)])
        self.row = Row(*self.keys, *self.COLUMNS, "previous_etag")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get()
        n = len(self.keys)
        last = {tuple(v[:n]): tuple(v[n:]) for v in zip(*known)} if known else {}
        # Keys, tags and types repeat, so they are kept once; a row then costs its time and version.
        seen: dict[tuple, list[tuple]] = {}
        for r in rows:
            place = r["written_at"], r["version"], _kept(r["etag"]), _kept(r["content_type"])
            seen.setdefault(tuple(r[c] for c in self.keys), []).append(place)
        changed = False
        for tile, places in seen.items():
            places.sort(key=lambda r: [(v is not None, v) for v in r[:2]])
            first = before = last.get(tile)
            for *place, tag, kind in places:
                if before is not None and before != (tag, kind):
                    yield self.row(*tile, *place, tag, kind, before[0])
                before = tag, kind
            last[tile] = before
            changed |= first != before
        if changed:
            self._keep(last)

    def _keep(self, last: dict[tuple, tuple]) -> None:
        self.last.update(tuple(list(c) for c in zip(*((*tile, *value) for tile, value in last.items()))))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep({tuple(r[c] for c in self.keys): (r["etag"], r["content_type"]) for r in initialState["tiles"]})

    def close(self) -> None:
        pass


def _kept(text: str | None) -> str | None:
    return text and sys.intern(text)


def change_stream(observations: DataFrame, keys: Sequence[str] = TILE, initial: DataFrame | None = None) -> DataFrame:
    """Alert when a tile's content or type differs from the observation before.

    The first observation of a tile sets its baseline, each later one moves it.  ``initial`` has
    each tile's last ``etag`` and ``content_type`` from before, at most one row a tile.
    """
    seen = observations.select(
        *keys, "written_at", "version", etag("content").alias("etag"), "content_type"
    )
    schema = _output(seen, [*keys, *Changes.COLUMNS], T.StructField("previous_etag", T.StringType()))
    block = {f"_{c}": F.shiftright(c, BLOCK_SHIFT) if c in ("x", "y") else F.col(c) for c in keys}
    if initial is not None:
        tiles = F.collect_list(F.struct(*keys, "etag", "content_type")).alias("tiles")
        initial = initial.withColumns(block).groupBy(*block).agg(tiles)
    return _stateful(seen.withColumns(block), list(block), Changes(_output(seen, keys)), schema, "None", initial)
