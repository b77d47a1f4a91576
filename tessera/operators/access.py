"""Permission audits of request logs and token checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.access import permission_verdict, scope_layers, scope_valid
from tessera.functions.tiles import as_col, bounds, geohash_bounds

# Anonymous rows carry no grant; they are spread over this many join keys.
SPREAD = 1024


def audit(requests: DataFrame, grants: DataFrame, spread_by: str = "request_id") -> DataFrame:
    """Add ``verdict`` (ok / layer / area / unknown) to resolved requests.

    Requests without a user are unrestricted.  They may be a large share of a log,
    so they get scattered join keys that match no grant instead of one hot key.
    """
    anonymous = F.coalesce("user_id", F.lit("")) == ""
    salt = F.when(anonymous, 1 + F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))).otherwise(F.lit(0))
    left = requests.withColumn("_salt", salt.cast("int")).withColumn(
        "_user", F.coalesce("user_id", F.lit(""))
    )
    right = grants.select(
        F.col("user_id").alias("_user"), F.lit(0).alias("_salt"),
        "limit_layers", "allowed_layers", "area", "partial",
    )
    joined = left.join(right, ["_user", "_salt"], "left")
    verdict = permission_verdict(
        "layer_id", "z", "x", "y", "limit_layers", "allowed_layers", "area",
        F.coalesce("partial", F.lit(False)),
    )
    return joined.withColumn(
        "verdict", F.when(F.col("layer_id").isNull(), F.lit("unknown")).otherwise(verdict)
    ).drop("_salt", "_user", "limit_layers", "allowed_layers", "area", "partial")


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.groupBy("user_id", "verdict").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("layer_id").alias("layers")
    )


def grants_from_claims(
    claims: DataFrame, required_scope: str = "", layer_scope: bool = False, prefix: str = ""
) -> DataFrame:
    """Grants from decoded claims (token, user_id, scope, geohash, partial).

    A wrong scope or geohash rejects the token: ``ok`` is false and it grants
    nothing.  Layers of several claims of one token add up.
    """
    area = F.when(F.col("geohash").isNull(), bounds(0, 0, 0, 0)).otherwise(geohash_bounds("geohash"))
    layers = (
        F.coalesce(scope_layers("scope", prefix), F.array().cast("array<string>"))
        if layer_scope
        else F.array().cast("array<string>")
    )
    return claims.select(
        "token",
        "user_id",
        F.lit(layer_scope).alias("limit_layers"),
        layers.alias("allowed_layers"),
        area.alias("area"),
        F.coalesce("partial", F.lit(False)).alias("partial"),
        (scope_valid("scope", required_scope, layer_scope) & area.isNotNull()).alias("ok"),
    )


def merge_grants(grants: DataFrame, key: str = "user_id") -> DataFrame:
    """Union of the layers granted to a user over several tokens.

    Layer names are deduplicated before they are gathered; a user's set is
    bounded by the layer catalog.
    """
    pairs = grants.where("ok").select(key, F.explode_outer("allowed_layers").alias("layer_id"))
    return pairs.distinct().groupBy(key).agg(
        F.sort_array(F.collect_list("layer_id")).alias("allowed_layers")
    )


def extract_token(
    sources: Mapping[str, str], headers="headers", cookies="cookies", query="query_params",
    path="path", y="y",
) -> Column:
    """First token found in header, cookie, query, then path suffix order.

    ``sources`` names which places count, for example ``{"header": "X-Token"}``.
    A path suffix counts only when it is not the tile row itself.
    """
    found = []
    if "header" in sources:
        found.append(F.try_element_at(as_col(headers), F.lit(sources["header"])))
    if "cookie" in sources:
        found.append(F.try_element_at(as_col(cookies), F.lit(sources["cookie"])))
    if "query" in sources:
        found.append(F.try_element_at(as_col(query), F.lit(sources["query"])))
    if "path" in sources:
        last = F.substring_index(as_col(path), "/", -1)
        found.append(F.when(last != as_col(y).cast("string"), last))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def validate_tokens(
    requests: DataFrame, validate: Callable[[str], Sequence], token: str = "token"
) -> DataFrame:
    """Run ``validate(token) -> (ok, expires, user_id, layers)`` once per distinct token.

    Adds a struct ``auth``.  The distinct step is the cache: a hot token is one
    row; the verdicts then join back by token.
    """
    schema = f"`{token}` string, ok boolean, expires bigint, user_id string, allowed_layers array<string>"
    tokens = requests.select(token).where(F.col(token).isNotNull()).distinct()

    def run(batches):
        import pandas as pd

        names = [token, "ok", "expires", "user_id", "allowed_layers"]
        for pdf in batches:
            rows = []
            for text in pdf[token]:
                ok, expires, user, layers = validate(text)
                rows.append((text, bool(ok), int(expires), user or "", list(layers or [])))
            yield pd.DataFrame(rows, columns=names)

    verdicts = tokens.mapInPandas(run, schema).select(
        token,
        F.struct(
            "ok", "expires", "user_id", (F.size("allowed_layers") > 0).alias("limit_layers"),
            "allowed_layers",
        ).alias("auth"),
    )
    # Rows without a token match nothing; scattered keys keep them out of one task.
    key = F.coalesce(F.col(token), F.concat(F.lit("\x00"), F.rand().cast("string")))
    verdicts = verdicts.withColumnRenamed(token, "_token")
    return requests.withColumn("_key", key).join(verdicts, F.col("_key") == F.col("_token"), "left").drop("_key", "_token")


def token_accepted(now) -> Column:
    """True when the joined ``auth`` is good and not past its expiry."""
    return F.coalesce(F.col("auth.ok") & (F.col("auth.expires") > as_col(now)), F.lit(False))
