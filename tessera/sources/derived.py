"""Tile-request, feature, raster and store tables derived from the given tables.

These are plain projections over the Parquet scans, so filters and column
pruning on them still reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import tile_key
from tessera.functions.tiles import bounds, geohash_bounds, tile_bounds
from tessera.sources.catalog import Layer

TILE = ["layer_name", "z", "x", "y"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def requests_from_events(events: DataFrame) -> DataFrame:
    """Request log from an event table; also works on a stream."""
    # The one-row explode keeps the JSON parse out of predicates pushed past it;
    # substituted there, it would run once per use of the layer name.
    k = F.explode(F.array(F.get_json_object("props", "$.k").cast("int")))
    z = (F.col("event_id") * 7 % 13).cast("int")
    base = events.withColumn("k", k).withColumn("z", z)
    base = base.withColumn("n", F.pow(F.lit(2.0), F.col("z")).cast("bigint"))
    user = F.col("user_id")
    event = F.col("event_id")
    kind = F.col("k") % 5
    storm = F.concat(
        F.lit("harbour_survey_2023090"),
        (1 + F.col("k") % 2).cast("string"),
        F.when(F.col("k") % 3 == 0, F.lit("a")).otherwise(F.lit("b")),
    )
    return base.select(
        event.alias("request_id"),
        F.col("ts").alias("time"),
        F.when(kind == 0, F.lit("osm"))
        .when(kind == 1, F.lit("osm-topo"))
        .when(kind == 2, storm)
        .when(kind == 3, F.concat(F.lit("counties_"), (1800 + F.col("k")).cast("string")))
        .otherwise(F.lit("debug-grid"))
        .alias("layer_name"),
        "z",
        ((event * 7919 + user * 104729) % F.col("n")).cast("int").alias("x"),
        ((event * 6007 + user * 1299709) % F.col("n")).cast("int").alias("y"),
        F.when(user % 5 == 0, F.lit(""))
        .otherwise(F.concat(F.lit("user-"), user.cast("string")))
        .alias("user_id"),
        F.concat_ws(
            ".", F.lit("10"), (user % 200).cast("string"), (event % 250).cast("string"), F.lit("7")
        ).alias("ip"),
        F.when(F.col("event_type") == "error", F.lit(500))
        .when(F.col("event_type") == "signup", F.lit(304))
        .otherwise(F.lit(200))
        .alias("status"),
        F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"),
        (500 + event * 31 % 20000).alias("bytes"),
        F.when(kind == 3, F.lit("application/vnd.mapbox-vector-tile"))
        .otherwise(F.lit("image/png"))
        .alias("content_type"),
    )


def tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_events(table(spark, sf_dir, "events"))


LAYERS = (
    Layer("osm"),
    Layer("osm-topo"),
    Layer(
        "harbour_survey_by_date",
        pattern="harbour_survey_{version}",
        rules={"version": "[0-9]{8}[ab]"},
    ),
    Layer("counties_by_year", pattern="counties_{year}", rules={"year": "^[0-9]{4}$"}),
    Layer("debug-grid", skip_analytics=True),
)


def tile_store(spark: SparkSession, sf_dir: str, every: int = 3) -> DataFrame:
    """Written tiles, several versions per key; content is the tile key."""
    return (
        tile_requests(spark, sf_dir)
        .where(F.col("request_id") % every == 0)
        .select(
            *TILE,
            F.col("time").alias("written_at"),
            F.col("request_id").alias("version"),
            tile_key("layer_name", "z", "x", "y").cast("binary").alias("content"),
            "content_type",
        )
    )


def previous_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier snapshot of the store: other content where version % 7 = 0."""
    store = tile_store(spark, sf_dir)
    return store.withColumn(
        "content",
        F.when(
            F.col("version") % 7 == 0,
            F.concat(F.col("content"), F.lit("-old").cast("binary")),
        ).otherwise(F.col("content")),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        (order * 10 + line).alias("gid"),
        (((order * 7919 + line * 104729) % 3600000).cast("double") / 10000.0 - 180.0).alias("lon"),
        (((part * 6007 + order * 31) % 1700000).cast("double") / 10000.0 - 85.0).alias("lat"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_quantity").alias("weight"),
    )


# Band offsets added to the base band, modulo 256.
BAND_SHIFT = {"r": 0, "g": 85, "b": 170}


def raster_tiles(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """8x8 RGBA rasters, one row per tile with one array per band."""

    def band(extra: int):
        return F.transform(
            "embedding",
            lambda v: (
                (F.floor(F.abs(v.cast("double")) * 1000).cast("int") + (extra + shift)) % 256
            ).cast("int"),
        )

    row = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("layer"),
        F.lit(5).alias("z"),
        (row % 32).cast("int").alias("x"),
        (F.floor(row / 32).cast("int") % 32).alias("y"),
        row.alias("vec_id"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        *[band(s).alias(name) for name, s in BAND_SHIFT.items()],
        F.array_repeat(F.lit(255), 64).alias("a"),
    )


def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs with a credential parameter appended to the query."""
    url = F.col("url")
    base = F.substring_index(url, "#", 1)
    frag = F.regexp_extract(url, r"(#.*)\z", 1)
    token = F.concat(
        F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?")),
        F.lit("token="),
        F.col("page_id").cast("string"),
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(base, token, frag).alias("url")
    )


def grants(spark: SparkSession) -> DataFrame:
    """Three restricted users; everybody else is unrestricted."""
    empty = bounds(0, 0, 0, 0)
    one = spark.range(1)

    def grant(user, limit, layers, area, partial):
        return one.select(
            F.lit(user).alias("user_id"),
            F.lit(limit).alias("limit_layers"),
            (F.array(*[F.lit(v) for v in layers]) if layers else F.array().cast("array<string>"))
            .alias("allowed_layers"),
            area.alias("area"),
            F.lit(partial).alias("partial"),
        )

    return (
        grant("user-1", True, ["osm"], empty, False)
        .unionByName(grant("user-2", False, [], geohash_bounds(F.lit("gb")), True))
        .unionByName(
            grant("user-3", False, [], tile_bounds(F.lit(3), F.lit(4), F.lit(2)), False)
        )
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seed region per customer with a zoom-range text."""
    key = F.col("c_custkey")
    west = (key * 7919 % 3400).cast("double") / 10.0 - 175.0
    south = (key * 6007 % 1200).cast("double") / 10.0 - 60.0
    return table(spark, sf_dir, "customer").select(
        key.alias("region_id"),
        F.concat(F.lit("seg-"), F.lower("c_mktsegment")).alias("layer_name"),
        bounds(
            south,
            south + 1.0 + (key % 7).cast("double"),
            west,
            west + 1.0 + (key % 11).cast("double") / 2.0,
        ).alias("area"),
        F.when(key % 3 == 0, F.lit("3-5,7")).otherwise(F.lit("4,6")).alias("zooms"),
    )
