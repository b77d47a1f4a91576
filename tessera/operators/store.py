"""Tile-store operators: lookups, freshness, diffs, validation and statistics.

A store row is (layer_name, z, x, y, written_at, version, content, content_type).
Comparisons move hashes, not payloads, through the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import etag, metric_name, safe_layer
from tessera.operators.numbering import with_previous

TILE = ["layer_name", "z", "x", "y"]


def latest_tiles(store: DataFrame, keys: Sequence[str] = TILE) -> DataFrame:
    """Last write per tile.

    ``max_by`` combines map-side, so many versions of one tile collapse before the
    shuffle instead of meeting in one window partition.
    """
    rest = [c for c in store.columns if c not in keys]
    return store.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("written_at", "version")).alias("_last")
    ).select(*keys, "_last.*")


def stored_keys(store: DataFrame) -> DataFrame:
    return store.select(*TILE).distinct()


def cache_lookup(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Add ``hit`` to every request; null where the layer skips the cache.

    Only keys travel.  The store side is unique, so a tile asked for millions of
    times is split by the adaptive skew join.
    """
    found = stored_keys(store).withColumn("_found", F.lit(True))
    joined = requests.join(found, TILE, "left")
    hit = F.coalesce("_found", F.lit(False))
    if "skip_cache" in requests.columns:
        hit = F.when(~F.coalesce("skip_cache", F.lit(False)), hit)
    return joined.withColumn("hit", hit).drop("_found")


def hit_rate(lookups: DataFrame, keys: Sequence[str] = ("layer_name",)) -> DataFrame:
    return lookups.where(F.col("hit").isNotNull()).groupBy(*keys).agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )


def tiered_lookup(requests: DataFrame, tiers: Sequence[DataFrame]) -> DataFrame:
    """First tier (1-based) holding each requested tile; null ``hit_tier`` is a miss.

    The tiers merge into one key table before the log is touched, so the log is
    shuffled once however many tiers there are.
    """
    merged = None
    for i, tier in enumerate(tiers, 1):
        part = tier.select(*TILE).withColumn("hit_tier", F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    first = merged.groupBy(*TILE).agg(F.min("hit_tier").alias("hit_tier"))
    return requests.join(first, TILE, "left")


def tiered_content(requests: DataFrame, tiers: Sequence[DataFrame]) -> DataFrame:
    """``tiered_lookup`` with the payload of the winning tier."""
    merged = None
    for i, tier in enumerate(tiers, 1):
        part = tier.select(*TILE, "content", "content_type").withColumn("hit_tier", F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    first = merged.groupBy(*TILE).agg(
        F.min_by(F.struct("content", "content_type"), "hit_tier").alias("_t"),
        F.min("hit_tier").alias("hit_tier"),
    ).select(*TILE, "_t.*", "hit_tier")
    return requests.join(first, TILE, "left")


CACHE_MODES = ("always", "unless-error", "unless-fallback")


def fallback(
    tiles: DataFrame,
    primary: DataFrame,
    secondary: DataFrame,
    in_zoom: Column,
    in_bounds: Column,
    mode: str = "unless-error",
) -> DataFrame:
    """Primary tile where zoom and bounds allow it and it did not fail, else secondary.

    Inputs carry (z, x, y, content, error).  Output adds ``source`` and
    ``skip_cache``, which follows the cache mode.  An out-of-bounds or
    out-of-zoom tile never looks at the primary's error.
    """
    if mode not in CACHE_MODES:
        raise ValueError(f"cache mode must be one of {', '.join(CACHE_MODES)}")
    key = ["z", "x", "y"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(F.lit(True).alias("there"), "content", "error").alias(name))

    joined = (
        tiles.withColumn("_eligible", in_zoom & F.coalesce(in_bounds, F.lit(False)))
        .join(side(primary, "_p"), key, "left")
        .join(side(secondary, "_s"), key, "left")
    )
    eligible = F.col("_eligible")
    failed = F.col("_p.there").isNull() | F.col("_p.error").isNotNull()
    use_primary = eligible & ~failed
    if mode == "always":
        skip = F.lit(False)
    elif mode == "unless-error":
        skip = eligible & failed
    else:
        skip = ~use_primary
    return joined.select(
        *tiles.columns,
        F.when(use_primary, F.lit("primary")).otherwise(F.lit("secondary")).alias("source"),
        F.when(use_primary, F.col("_p.content")).otherwise(F.col("_s.content")).alias("content"),
        F.when(~use_primary & F.col("_s.there").isNull(), F.lit("no tile"))
        .when(~use_primary, F.col("_s.error"))
        .alias("error"),
        skip.alias("skip_cache"),
    )


def _fingerprints(store: DataFrame) -> DataFrame:
    return store.select(*TILE, etag("content").alias("etag"), "content_type")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """added / removed / changed / same per tile of two one-row-per-key snapshots."""
    a = _fingerprints(old).withColumnsRenamed({"etag": "old_etag", "content_type": "old_type"})
    b = _fingerprints(new).withColumnsRenamed({"etag": "new_etag", "content_type": "new_type"})
    change = (
        F.when(F.col("old_etag").isNull(), F.lit("added"))
        .when(F.col("new_etag").isNull(), F.lit("removed"))
        .when(
            (F.col("old_etag") != F.col("new_etag"))
            | ~F.col("old_type").eqNullSafe(F.col("new_type")),
            F.lit("changed"),
        )
        .otherwise(F.lit("same"))
    )
    return a.join(b, TILE, "full_outer").withColumn("change", change)


def change_points(observations: DataFrame) -> DataFrame:
    """Observations whose content or type differs from the one before (same tile)."""
    seen = observations.select(
        *TILE, "written_at", "version", etag("content").alias("etag"), "content_type"
    )
    now = F.struct("etag", "content_type")
    return (
        with_previous(seen, TILE, ["written_at", "version"], now)
        .where(F.col("previous").isNotNull() & ~F.col("previous").eqNullSafe(now))
        .withColumn("previous_etag", F.col("previous.etag"))
        .drop("previous")
    )


VALIDATIONS = ("same", "content-type", "base-64", "file", "success")


def validate_tiles(tiles: DataFrame, expectations: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Check stored tiles against (tile key, validation, expected) rows.

    ``expected`` is text; for ``file`` it is the hex SHA-256 of the expected bytes,
    so reference payloads need not travel.  ``same`` compares content and type with
    the tile in ``previous``, an earlier snapshot; it fails where there is none.
    """
    got = tiles.select(*TILE, "content", "content_type").withColumn("_there", F.lit(True))
    joined = expectations.join(got, TILE, "left")
    now = F.struct(etag("content").alias("etag"), F.col("content_type").alias("type"))
    if previous is None:
        joined = joined.withColumn("_before", F.lit(None).cast("struct<etag:string,type:string>"))
    else:
        joined = joined.join(previous.select(*TILE, now.alias("_before")), TILE, "left")
    mode, want = F.col("validation"), F.col("expected")
    error = (
        F.when(F.col("_there").isNull(), F.lit("no tile"))
        .when((mode == "content-type") & ~F.col("content_type").eqNullSafe(want), F.lit("content type"))
        .when((mode == "base-64") & ~F.base64("content").eqNullSafe(want), F.lit("content"))
        .when(
            (mode == "file") & ~F.sha2("content", 256).eqNullSafe(F.lower(want)),
            F.lit("result changed"),
        )
        .when((mode == "same") & F.col("_before").isNull(), F.lit("no previous tile"))
        .when((mode == "same") & ~F.col("_before").eqNullSafe(now), F.lit("result changed"))
        .when(~mode.isin(*VALIDATIONS), F.lit("unknown validation"))
    )
    return joined.select(*expectations.columns, error.alias("error"))


def verify_store(generated: DataFrame, store: DataFrame) -> DataFrame:
    """Compare generated tiles with what the store gives back.

    ``generated`` has (tile key, content, error, written) where ``written`` tells
    whether the store accepted the write.
    """
    read = store.select(*TILE, etag("content").alias("_read"))
    made = generated.select(*TILE, etag("content").alias("_made"), "error", "written")
    ok, wrote = F.col("error").isNull(), F.col("written")
    return made.join(read, TILE, "left").select(
        *TILE,
        ok.alias("generated"),
        F.when(ok, wrote).alias("cache_write"),
        F.when(ok & wrote, F.coalesce(F.col("_read") == F.col("_made"), F.lit(False))).alias("cache_read"),
        F.when(~ok, F.col("error"))
        .when(~wrote, F.lit("write failed"))
        .when(F.col("_read").isNull(), F.lit("not in the store"))
        .when(F.col("_read") != F.col("_made"), F.lit("other content in the store"))
        .alias("error"),
    )


def verify_summary(verified: DataFrame) -> DataFrame:
    return verified.groupBy("layer_name").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.count_if("generated").alias("generated"),
        F.count_if("cache_write").alias("cache_write"),
        F.count_if("cache_read").alias("cache_read"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def fresh_tiles(store: DataFrame, ttl_seconds: int, now) -> DataFrame:
    """Tiles still inside their lifetime, which runs from the write."""
    return store.where(F.timestamp_add("SECOND", F.lit(ttl_seconds), F.col("written_at")) > now)


def missing_tiles(plan: DataFrame, store: DataFrame, ttl_seconds: int | None = None, now=None) -> DataFrame:
    """Planned tiles the store lacks or holds only past their lifetime."""
    held = store if ttl_seconds is None else fresh_tiles(store, ttl_seconds, now)
    return plan.join(held.select(*TILE), TILE, "left_anti")


def present_tiles(plan: DataFrame, store: DataFrame) -> DataFrame:
    return plan.join(store.select(*TILE), TILE, "left_semi")


def collisions(names: DataFrame, name: str = "layer_name", kind: str = "store") -> DataFrame:
    """Distinct names that share one safe key (or metric name), one row per name.

    Rows, not arrays: a key shared by very many names stays spread out.
    """
    safe = safe_layer(name) if kind == "store" else metric_name(name)
    distinct = names.select(name).distinct().withColumn("safe_name", safe)
    shared = (
        distinct.groupBy("safe_name").agg(F.count(F.lit(1)).alias("names")).where(F.col("names") > 1)
    )
    return distinct.join(shared, "safe_name")


def store_stats(store: DataFrame) -> DataFrame:
    """Tiles, bytes and distinct contents per layer and zoom."""
    sized = store.select(
        "layer_name", "z", F.octet_length("content").cast("long").alias("n"), etag("content").alias("e")
    )
    # Equal payloads collapse first, so the distinct count rides on the same shuffle.
    per_content = sized.groupBy("layer_name", "z", "e").agg(
        F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("bytes")
    )
    return per_content.groupBy("layer_name", "z").agg(
        F.sum("tiles").alias("tiles"),
        F.sum("bytes").alias("bytes"),
        F.count(F.lit(1)).alias("distinct_contents"),
    )


def first_fetches(
    requests: DataFrame, ttl_seconds: int, keys: Sequence[str] = TILE, time: str = "time"
) -> DataFrame:
    """Requests that reach the upstream when every fetch is kept for ``ttl_seconds``.

    The first request of a tile fetches it; so does the first one at or after the
    end of that copy's lifetime, and so on.  Lifetimes count whole seconds, as the
    key-value stores do, so requests are first combined per (tile, second); that
    bounds a tile's rows by the seconds covered, however often it is asked for.
    The scan along a tile streams over sorted partitions and keeps one number.
    """
    second = F.unix_timestamp(F.col(time).cast("timestamp"))
    seconds = requests.groupBy(*keys, second.alias("fetched_at")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    ordered = seconds.repartition(*keys).sortWithinPartitions(*keys, "fetched_at")
    names = list(keys)

    def scan(batches):
        import numpy as np

        tile, free_at = None, -(2**62)
        for pdf in batches:
            if pdf.empty:
                continue
            same = (pdf[names] == pdf[names].shift()).all(axis=1).to_numpy()
            starts = np.flatnonzero(~same)
            ends = np.append(starts[1:], len(pdf))
            times = pdf["fetched_at"].to_numpy()
            carried = tuple(pdf[names].iloc[0]) == tile
            free_at = free_at if carried else -(2**62)
            # A tile seen in one second only always fetches, save one begun before.
            busy = ends - starts > 1
            busy[0] = busy[-1] = True
            keep = list(starts[~busy])
            for start, end in zip(starts[busy], ends[busy]):
                if start:
                    free_at = -(2**62)
                part = times[start:end]
                at = int(np.searchsorted(part, free_at))
                while at < len(part):
                    keep.append(start + at)
                    free_at = int(part[at]) + ttl_seconds
                    at += max(1, int(np.searchsorted(part[at:], free_at)))
            tile = tuple(pdf[names].iloc[-1])
            if keep:
                yield pdf.iloc[keep][[*names, "fetched_at"]]

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in seconds.schema if f.name in names]
        + ["fetched_at bigint"]
    )
    return ordered.mapInPandas(scan, schema)
