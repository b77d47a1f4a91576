"""Permissions, claims, error classes and upstream-response policy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tiles import (
    as_col,
    bounds_contain,
    bounds_intersect,
    is_null_island,
    tile_bounds,
    tile_error,
)

# HTTP status of each error class.
STATUS_OF_CLASS = {
    "auth": 401,
    "bounds": 400,
    "provider": 500,
    "badrequest": 400,
    "other": 500,
}
STATUS_CANCELLED = 499
SUCCESS_STATUSES = (200, 304)

# What is accepted from an upstream unless configured otherwise.
DEFAULT_STATUSES = (200,)
DEFAULT_CONTENT_TYPES = (
    "image/png",
    "image/jpg",
    "image/jpeg",
    "application/vnd.mapbox-vector-tile",
    "application/x-protobuf",
)
DEFAULT_MAX_LENGTH = 10 * 1024 * 1024
DEFAULT_REWRITE = {"application/octet-stream": ""}
DEFAULT_MAX_EXPIRATION = 24 * 60 * 60
DEFAULT_LEEWAY = 5


def error_status(error_class, always_ok=False) -> Column:
    cls = as_col(error_class)
    status = F.lit(STATUS_OF_CLASS["other"])
    for name, code in STATUS_OF_CLASS.items():
        status = F.when(cls == name, F.lit(code)).otherwise(status)
    return (
        F.when(cls.isNull(), F.lit(None).cast("int"))
        .when(cls == "cancelled", F.lit(STATUS_CANCELLED))
        .when(as_col(always_ok), F.lit(200))
        .otherwise(status)
    )


def permission_verdict(layer_id, z, x, y, limit_layers, allowed_layers, area, partial) -> Column:
    """``ok``, ``layer`` or ``area``: the first rule that denies a request wins.

    Layer limits compare layer IDs.  Null-island bounds leave the area open; an
    invalid tile under an area limit is denied.
    """
    layer_id, area = as_col(layer_id), as_col(area)
    allowed = F.coalesce(F.array_contains(as_col(allowed_layers), layer_id), F.lit(False))
    tile = tile_bounds(z, x, y)
    inside = F.when(as_col(partial), bounds_intersect(area, tile)).otherwise(
        bounds_contain(area, tile)
    )
    limited = F.coalesce(as_col(limit_layers), F.lit(False))
    open_area = F.coalesce(is_null_island(area), F.lit(True))
    return (
        F.when(limited & ~allowed, F.lit("layer"))
        .when(~open_area & tile_error(z, x, y).isNotNull(), F.lit("area"))
        .when(~open_area & ~F.coalesce(inside, F.lit(False)), F.lit("area"))
        .otherwise(F.lit("ok"))
    )


def scope_layers(scope, prefix: str = "") -> Column:
    """Layers granted by a space-separated scope claim."""
    parts = F.split(as_col(scope), " ", -1)
    mine = F.filter(parts, lambda s: s.startswith(prefix)) if prefix else parts
    return F.transform(mine, lambda s: F.substring(s, F.lit(len(prefix) + 1), F.length(s)))


def scope_valid(scope, required: str = "", layer_scope: bool = False) -> Column:
    """A missing scope passes only when nothing depends on it."""
    scope = as_col(scope)
    absent_ok = F.lit(not (layer_scope or required))
    present_ok = F.array_contains(F.split(scope, " ", -1), required) if required else F.lit(True)
    return F.when(scope.isNull(), absent_ok).otherwise(present_ok)


def claims_valid(
    exp,
    now,
    aud=None,
    sub=None,
    iss=None,
    audience: str = "",
    subject: str = "",
    issuer: str = "",
    max_expiration: int = DEFAULT_MAX_EXPIRATION,
    nbf=None,
    leeway: int = DEFAULT_LEEWAY,
) -> Column:
    """Test already-decoded claims at an explicit ``now`` (both epoch seconds).

    A token with ``nbf`` is refused before that time, less ``leeway`` seconds.  ``exp`` must exist, lie ahead and not lie more than ``max_expiration`` ahead.
    ``aud`` is an array column; wrap a plain string claim in ``array()``.
    """
    exp, now = as_col(exp), as_col(now)
    ok = exp.isNotNull() & (exp >= now) & (exp - now <= max_expiration)
    if nbf is not None:
        ok = ok & F.coalesce(as_col(nbf) <= now + leeway, F.lit(True))
    if audience:
        ok = ok & F.array_contains(as_col(aud), audience)
    if subject:
        ok = ok & (as_col(sub) == subject)
    if issuer:
        ok = ok & (as_col(iss) == issuer)
    return F.coalesce(ok, F.lit(False))


@dataclass(frozen=True)
class ResponsePolicy:
    statuses: tuple[int, ...] = DEFAULT_STATUSES
    content_types: tuple[str, ...] = DEFAULT_CONTENT_TYPES
    max_length: int = DEFAULT_MAX_LENGTH
    unknown_length: bool = False
    rewrite: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_REWRITE))


def policy_struct(policy: ResponsePolicy = ResponsePolicy()) -> Column:
    return F.struct(
        F.array(*[F.lit(s) for s in policy.statuses]).alias("statuses"),
        F.array(*[F.lit(t) for t in policy.content_types]).alias("content_types"),
        F.lit(policy.max_length).cast("long").alias("max_length"),
        F.lit(policy.unknown_length).alias("unknown_length"),
        F.create_map(*[F.lit(v) for kv in policy.rewrite.items() for v in kv]).alias("rewrite"),
    )


def response_verdict(status, content_type, declared_length, actual_length, policy=None) -> Column:
    """``STRUCT<error, content_type>`` for one upstream response.

    ``declared_length`` is -1 when the upstream did not say.  ``policy`` is a
    struct column from ``policy_struct`` or a policy join.
    """
    p = policy_struct() if policy is None else as_col(policy)
    status, ctype = as_col(status), as_col(content_type)
    declared, actual = as_col(declared_length), as_col(actual_length)
    error = (
        F.when(~F.array_contains(p["statuses"], status), F.lit("status"))
        .when(~F.array_contains(p["content_types"], ctype), F.lit("content_type"))
        .when((declared == -1) & ~p["unknown_length"], F.lit("length"))
        .when((declared != -1) & (declared > p["max_length"]), F.lit("length"))
        .when(actual > p["max_length"], F.lit("length"))
    )
    rewritten = F.coalesce(F.try_element_at(p["rewrite"], ctype), ctype)
    return F.struct(
        error.alias("error"), F.when(error.isNull(), rewritten).alias("content_type")
    )
