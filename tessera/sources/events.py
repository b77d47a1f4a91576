"""Usage events: reading, building from request logs, optional fields."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.access import SUCCESS_STATUSES
from tessera.functions.tiles import as_col
from tessera.operators.layers import resolve_layers
from tessera.sources.catalog import Layer, check_catalog

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("layer", T.StringType()),
        T.StructField("layer_name", T.StringType()),
        T.StructField("z", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Optional event fields, in the order they are offered.
FIELDS = (
    "layername",
    "layerparams",
    "ip",
    "useragent",
    "referer",
    "host",
    "method",
    "path",
    "query",
    "duration",
    "bytes",
    "contenttype",
)
NUMERIC_FIELDS = ("duration", "bytes")

# Where each optional field lives in a request log.
FIELD_COLUMNS = {
    "layername": "layer_name",
    "layerparams": "layer_params",
    "ip": "ip",
    "host": "host",
    "method": "method",
    "path": "path",
    "query": "query_string",
    "duration": "duration_ms",
    "bytes": "bytes",
    "contenttype": "content_type",
}
FIELD_HEADERS = {"useragent": "User-Agent", "referer": "Referer"}


def read_tile_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def header_name(name: str) -> str:
    """Canonical Header-Case; a name with illegal characters stays as it is."""
    if not re.fullmatch(r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
        return name
    return "-".join(part[:1].upper() + part[1:].lower() for part in name.split("-"))


def json_string(v) -> Column:
    """A string as a quoted JSON text."""
    wrapped = F.to_json(F.array(as_col(v)))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def _json_value(key: Column, value: Column) -> Column:
    number = key.isin(*NUMERIC_FIELDS) & value.rlike(r"\A-?[0-9]+\z")
    raw = number | ((key == "layerparams") & value.startswith("{"))
    return F.when(raw, value).otherwise(json_string(value))


def json_object(values) -> Column:
    """A MAP as a JSON object with sorted keys; null gives ``{}``."""
    entries = F.array_sort(F.map_entries(as_col(values)))
    members = F.transform(
        entries,
        lambda e: F.concat(json_string(e["key"]), F.lit(":"), _json_value(e["key"], e["value"])),
    )
    return F.concat(F.lit("{"), F.coalesce(F.array_join(members, ","), F.lit("")), F.lit("}"))


def resolve_fields(
    df: DataFrame, fields: Iterable[str] = (), extra: Mapping[str, str] | None = None
) -> Column:
    """MAP of the chosen fields; a missing value leaves its key out.

    ``extra`` values read ``ctx.name`` (a column), ``hdr.Name`` (an entry of the
    ``headers`` map) or stand for themselves, and win over a field of that name.
    """
    have = set(df.columns)
    values: dict[str, Column] = {}

    def header(name: str) -> Column:
        if "headers" not in have:
            return F.lit(None).cast("string")
        return F.try_element_at(F.col("headers"), F.lit(header_name(name)))

    def column(name: str) -> Column:
        if name in have:
            return F.col(f"`{name}`").cast("string")
        return header(name) if header_name(name) == name else F.lit(None).cast("string")

    for field in fields:
        key = field.lower()
        if key not in FIELDS:
            raise ValueError(f"unknown field {field!r}; choose from {', '.join(FIELDS)}")
        if key in FIELD_HEADERS:
            values[key] = header(FIELD_HEADERS[key])
        elif key == "layerparams":
            values[key] = (
                F.to_json("layer_params") if "layer_params" in have else F.lit(None).cast("string")
            )
        else:
            values[key] = column(FIELD_COLUMNS[key])
    for key, spec in (extra or {}).items():
        if spec.startswith("ctx."):
            values[key] = column(spec[4:])
        elif spec.startswith("hdr."):
            values[key] = header(spec[4:])
        else:
            values[key] = F.lit(spec)
    if not values:
        return F.lit(None).cast("map<string,string>")
    entries = [v for k in sorted(values) for v in (F.lit(k), values[k])]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def to_tile_events(
    requests: DataFrame,
    layers: Iterable[Layer],
    fields: Iterable[str] = ("duration", "bytes", "contenttype"),
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """Events of the served tiles.  One narrow pass: no join, no shuffle."""
    served = requests.where(F.col("status").isin(*SUCCESS_STATUSES))
    catalog = check_catalog(layers)
    # Null, for no layer, passes no filter.
    known = resolve_layers(served, catalog).where(~F.col("skip_analytics"))
    return known.select(
        F.col("request_id").alias("event_id"),
        "time",
        F.col("layer_id").alias("layer"),
        "layer_name",
        "z",
        "x",
        "y",
        F.coalesce("user_id", F.lit("")).alias("user_id"),
        resolve_fields(known, fields, extra).alias("extra"),
    )
