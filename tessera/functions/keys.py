"""Tile keys, store keys, entity tags and other identifier functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tiles import as_col, let

KEY_LIMIT = 250
HASH_SUFFIX = 16
METRIC_NAME_LIMIT = 200


def tile_key(layer, z, x, y, sep: str = "/") -> Column:
    parts = [as_col(layer)] + [as_col(v).cast("string") for v in (z, x, y)]
    return F.concat_ws(sep, *parts)


def parse_tile_path(path) -> Column:
    """Split ``/{root}/{tiles}/{layer}/{z}/{x}/{y}`` (any lead) into a struct.

    ``error`` is ``BadRequest`` when a coordinate is not an integer and
    ``NotFound`` when the path has too few parts.
    """
    bare = F.regexp_replace(as_col(path), r"[?#].*\z", "")

    def last(parts, k):
        return F.try_element_at(parts, F.lit(-k))

    # Only plain signed digits are integers here; no blanks, no fractions.
    def number(text):
        return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("long"))

    def tile(parts):
        z, x, y = (number(last(parts, k)) for k in (3, 2, 1))
        return F.struct(
            last(parts, 4).alias("layer_name"), z.alias("z"), x.alias("x"), y.alias("y"),
            (F.size(parts) < 4).alias("short"),
        )

    return let(
        let(F.split(bare, "/", -1), tile),
        lambda t: F.struct(
            t["layer_name"].alias("layer_name"), t["z"].alias("z"), t["x"].alias("x"), t["y"].alias("y"),
            F.when(t["short"], F.lit("NotFound"))
            .when(t["z"].isNull() | t["x"].isNull() | t["y"].isNull(), F.lit("BadRequest"))
            .alias("error"),
        ),
    )


def safe_layer(name) -> Column:
    """Layer name that is safe inside a file name or object key (many-to-one)."""
    plain = F.regexp_replace(as_col(name), r"[^A-Za-z0-9\-.]", "_")
    plain = F.regexp_replace(plain, r"\.{2,}", "_")
    # A name that is only "." is a folder of its own.
    return F.regexp_replace(plain, r"\A\.\z", "_")


def _bytes_head(value: Column, n: Column) -> Column:
    return F.substring(value.cast("binary"), F.lit(1), n).cast("string")


def bounded_key(prefix, body) -> Column:
    """Key of at most 250 bytes; a longer one ends in a hash of the whole key."""
    room = KEY_LIMIT - HASH_SUFFIX - 1

    def bound(p):
        key = F.concat(p["prefix"], p["body"])
        suffix = F.concat(F.lit("_"), F.substring(F.sha2(key.cast("binary"), 256), 1, HASH_SUFFIX))
        prefix_len = F.least(F.octet_length(p["prefix"]), F.lit(room))
        short = F.concat(
            _bytes_head(p["prefix"], prefix_len), _bytes_head(p["body"], F.lit(room) - prefix_len), suffix
        )
        size = F.octet_length(p["prefix"]) + F.octet_length(p["body"])
        return F.when(size <= KEY_LIMIT, key).otherwise(short)

    return let(F.struct(as_col(prefix).alias("prefix"), as_col(body).alias("body")), bound)


def store_key(layout: str, layer, z, x, y, prefix: str = "") -> Column:
    """Key of a tile in a ``disk``, ``object``, ``redis`` or ``memcache`` store."""
    if layout == "disk":
        return tile_key(safe_layer(layer), z, x, y, "_")
    if layout == "object":
        return F.concat(F.lit(prefix), tile_key(safe_layer(layer), z, x, y))
    if layout == "redis":
        return F.concat(F.lit(prefix), tile_key(layer, z, x, y))
    if layout == "memcache":
        return bounded_key(F.lit(prefix), tile_key(safe_layer(layer), z, x, y))
    raise ValueError(f"unknown store layout {layout!r}")


def etag(content) -> Column:
    return F.concat(F.lit('"'), F.sha2(as_col(content).cast("binary"), 256), F.lit('"'))


def etag_matches(header, tag) -> Column:
    """If-None-Match test: empty is false, ``*`` is true, weak tags compare equal."""
    header, tag = F.coalesce(as_col(header), F.lit("")), as_col(tag)
    listed = F.exists(
        F.split(header, ",", -1),
        lambda e: F.regexp_replace(F.regexp_replace(e, r"\A\s+|\s+\z", ""), r"\AW/", "") == tag,
    )
    return F.when(header == "", F.lit(False)).when(header == "*", F.lit(True)).otherwise(listed)


def metric_name(layer_id) -> Column:
    return F.substring(
        F.regexp_replace(as_col(layer_id), r"[^A-Za-z0-9_-]", "_"), 1, METRIC_NAME_LIMIT
    )


def remote_ip(addr) -> Column:
    """Text before the first colon; an IPv6 address degrades to its first group."""
    return F.substring_index(as_col(addr), ":", 1)


def client_id(user, ip) -> Column:
    user, ip = as_col(user), as_col(ip)
    return F.coalesce(
        F.nullif(user, F.lit("")),
        F.sha2(F.nullif(ip, F.lit("")).cast("binary"), 256),
        F.lit("anonymous"),
    )


def parse_color(text) -> Column:
    """3, 4, 6 or 8 hex digits to ``STRUCT<r,g,b,a>``; anything else gives null."""
    text = as_col(text)
    size = F.length(text)
    wide = F.when(size < 6, F.regexp_replace(text, "(.)", "$1$1")).otherwise(text)

    def channel(at):
        return F.conv(F.substring(wide, at, 2), 16, 10).cast("int")

    alpha = F.when(size.isin(4, 8), channel(7)).otherwise(F.lit(255))
    ok = text.rlike(r"\A([0-9A-Fa-f]{3,4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})\z")
    return F.when(
        ok,
        F.struct(
            channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b"), alpha.alias("a")
        ),
    )
