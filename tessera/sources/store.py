"""Tile-store files: inventory of existing stores, and our own Parquet store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.tiles import as_col
from tessera.operators.store import TILE, latest_tiles

_LAYOUTS = {
    # Disk layers may hold "_", so the coordinates are anchored from the right.
    "disk": r"\A(?:.*/)?([^/]+)_([0-9]+)_([0-9]+)_([0-9]+)\z",
    "object": r"\A(?:.*/)?([^/]+)/([0-9]+)/([0-9]+)/([0-9]+)\z",
    "redis": r"\A(.+)/([0-9]+)/([0-9]+)/([0-9]+)\z",
    "memcache": r"\A(.+)/([0-9]+)/([0-9]+)/([0-9]+)\z",
}


def parse_store_key(key, layout: str, prefix: str = "") -> Column:
    """STRUCT<layer_name,z,x,y> of a store key, null for a foreign key."""
    if layout not in _LAYOUTS:
        raise ValueError(f"layout must be one of {', '.join(_LAYOUTS)}")
    key, regex = as_col(key), _LAYOUTS[layout]
    body = (
        F.when(key.startswith(prefix), F.substring(key, F.lit(len(prefix) + 1), F.length(key)))
        if prefix
        else key
    )
    return F.when(
        body.rlike(regex),
        F.struct(
            F.regexp_extract(body, regex, 1).alias("layer_name"),
            *[
                F.regexp_extract(body, regex, k).cast("int").alias(name)
                for k, name in ((2, "z"), (3, "x"), (4, "y"))
            ],
        ),
    )


def scan_tile_store(
    spark: SparkSession, root: str, layout: str = "disk", with_content: bool = False
) -> DataFrame:
    """Tiles found under a folder.  Payloads are read only when asked for."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    found = files.withColumn("_t", parse_store_key(path, layout)).where(F.col("_t").isNotNull())
    columns = ["_t.*", F.col("length").alias("bytes"), F.col("modificationTime").alias("written_at"), "path"]
    return found.select(*columns, *(["content"] if with_content else []))


def list_tile_store(keys: DataFrame, layout: str, prefix: str = "", key: str = "key") -> DataFrame:
    """Tiles named by a listing of object keys, one per row; further columns (size, time) stay.

    For large stores: nothing is listed on the driver, and foreign keys are left out.
    """
    found = keys.withColumn("_t", parse_store_key(key, layout, prefix)).where(F.col("_t").isNotNull())
    return found.select("_t.*", *keys.columns)


def storable(tiles: DataFrame) -> DataFrame:
    """Rows that may be stored: no error, not flagged to skip, layer not uncached."""
    out = tiles
    for flag in ("skip_cache", "layer_skip_cache"):
        if flag in out.columns:
            out = out.where(~F.coalesce(F.col(flag), F.lit(False))).drop(flag)
    if "error" in out.columns:
        out = out.where(F.col("error").isNull()).drop("error")
    return out


def write_tile_store(tiles: DataFrame, path: str) -> None:
    """Append the latest version of each tile to a store.

    An upsert is an append: readers take the last write per tile, and
    ``compact_tile_store`` drops older ones.  The rebalance hint lets the adaptive
    planner size the files of hot and cold (layer, zoom) folders alike.
    """
    last = latest_tiles(storable(tiles))
    (
        last.withColumn("layer", F.col("layer_name"))
        .withColumn("zoom", F.col("z"))
        .hint("rebalance", "layer", "zoom")
        .write.mode("append")
        .partitionBy("layer", "zoom")
        .parquet(path)
    )


def read_tile_store(spark: SparkSession, path: str, versions: bool = False) -> DataFrame:
    stored = spark.read.parquet(path).drop("layer", "zoom")
    return stored if versions else latest_tiles(stored)


def compact_tile_store(spark: SparkSession, path: str, target: str) -> None:
    write_tile_store(read_tile_store(spark, path, versions=True), target)


def unchanged_removed(new: DataFrame, current: DataFrame) -> DataFrame:
    """Rendered tiles that differ from what is stored; equal ones need no write."""
    held = current.select(
        *TILE, F.sha2("content", 256).alias("_held"), F.col("content_type").alias("_type")
    )
    joined = new.join(held, TILE, "left")
    same = F.sha2("content", 256).eqNullSafe(F.col("_held")) & F.col("content_type").eqNullSafe(
        F.col("_type")
    )
    return joined.where(F.col("_held").isNull() | ~same).drop("_held", "_type")
