"""Event sinks: the shapes events take on their way out, and the writers."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import client_id
from tessera.operators.numbering import chunk
from tessera.sources.events import json_object, json_string

# Sink columns in their order, and the payload limits.
COLUMNS = ("time", "layer", "z", "x", "y", "user_id", "extra")
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)?"
MAX_PAYLOAD_EVENTS = 25
EVENT_NAME = "tile_request"
MAX_BATCH = 1000


def check_identifier(name: str) -> str:
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"{name!r} is not a plain identifier")
    return name


def sink_columns(overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """Column names with overrides; unknown logical names are an error."""
    names = {c: c for c in COLUMNS}
    for key, value in (overrides or {}).items():
        if key not in names:
            raise ValueError(f"unknown column {key!r}; choose from {', '.join(COLUMNS)}")
        names[key] = value
    return {k: check_identifier(v) for k, v in names.items()}


def _in_order(shaped: dict[str, Column], columns: Mapping[str, str] | None) -> list[Column]:
    names = sink_columns(columns)
    return [shaped[c].alias(names[c]) for c in COLUMNS]


def events_json(events: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Relational shape: seven columns, ``extra`` as JSON text, never null."""
    shaped = {c: F.col(c) for c in COLUMNS}
    shaped["extra"] = json_object("extra")
    return events.select(*_in_order(shaped, columns))


def events_map(events: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Map shape: whole seconds, narrow integers, ``extra`` as MAP<STRING,STRING>."""
    shaped = {c: F.col(c) for c in COLUMNS}
    shaped["time"] = F.date_trunc("second", F.col("time"))
    shaped["z"] = F.col("z").cast("smallint")
    shaped["x"], shaped["y"] = F.col("x").cast("bigint"), F.col("y").cast("bigint")
    empty = F.create_map().cast("map<string,string>")
    shaped["extra"] = F.coalesce(F.transform_values("extra", lambda k, v: v.cast("string")), empty)
    return events.select(*_in_order(shaped, columns))


def _write(df: DataFrame, target: str, jdbc: Mapping[str, str] | None) -> None:
    if jdbc is None:
        df.write.mode("append").parquet(target)
    else:
        df.write.format("jdbc").mode("append").options(dbtable=check_identifier(target), **jdbc).save()


def write_events_json(
    events: DataFrame, target: str, columns: Mapping[str, str] | None = None, jdbc: Mapping[str, str] | None = None
) -> None:
    """Append to a Parquet folder, or to a table when ``jdbc`` options are given."""
    _write(events_json(events, columns), target, jdbc)


def write_events_map(events: DataFrame, target: str, columns: Mapping[str, str] | None = None) -> None:
    """Append; Spark's commit makes a batch appear whole or not at all."""
    _write(events_map(events, columns), target, None)


def _event_key() -> Column:
    return F.coalesce(F.try_element_at(F.col("extra"), F.lit("ip")), F.lit(""))


def ga_payloads(
    events: DataFrame, event_name: str = EVENT_NAME, max_events: int = MAX_PAYLOAD_EVENTS
) -> DataFrame:
    """Measurement payloads: one client each, at most ``max_events`` events.

    Events are numbered per client without gathering a client, so the anonymous
    client may hold most of the log.
    """
    merged = F.map_concat(
        F.map_filter(
            F.create_map(
                F.lit("layer"), json_string("layer"),
                F.lit("x"), F.col("x").cast("string"),
                F.lit("y"), F.col("y").cast("string"),
                F.lit("z"), F.col("z").cast("string"),
            ),
            # An extra field of the same name wins.
            lambda k, v: ~F.coalesce(F.array_contains(F.map_keys("extra"), k), F.lit(False)),
        ),
        F.coalesce(
            F.map_from_entries(
                F.transform(
                    F.map_entries("extra"),
                    lambda e: F.struct(e["key"].alias("key"), _param_json(e).alias("value")),
                )
            ),
            F.create_map().cast("map<string,string>"),
        ),
    )
    members = F.array_join(
        F.transform(
            F.array_sort(F.map_entries(merged)),
            lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]),
        ),
        ",",
    )
    event = F.concat(
        F.lit('{"name":'), json_string(F.lit(event_name)), F.lit(',"params":{'), members, F.lit("}}")
    )
    keyed = events.withColumn("client_id", client_id("user_id", _event_key()))
    cut = chunk(keyed, ["client_id"], ["time", "event_id"], max_events)
    grouped = cut.groupBy("client_id", "chunk").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.max(F.nullif("user_id", F.lit(""))).alias("user_id"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", event.alias("e")))), lambda s: s["e"]
            ),
            ",",
        ).alias("_events"),
    )
    user = F.when(
        F.col("user_id").isNotNull(), F.concat(F.lit(',"user_id":'), json_string("user_id"))
    ).otherwise(F.lit(""))
    payload = F.concat(
        F.lit('{"client_id":'), json_string("client_id"), user, F.lit(',"events":['),
        F.col("_events"), F.lit("]}"),
    )
    return grouped.select("client_id", "chunk", "n", payload.alias("payload"))


def _param_json(e: Column) -> Column:
    number = e["key"].isin("bytes", "duration") & e["value"].rlike(r"\A-?[0-9]+\z")
    return F.when(number, e["value"]).otherwise(json_string(e["value"]))


def rfc3339(time) -> Column:
    """UTC time text with trailing zeros of the fraction cut off."""
    text = F.date_format(F.col(time) if isinstance(time, str) else time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+\z", ""), F.lit("Z"))


def webhook_batches(events: DataFrame, max_size: int = MAX_BATCH) -> DataFrame:
    """JSON-array payloads of ``max_size`` events in time order; empty parts are left out."""
    user = F.when(
        F.col("user_id") != "", F.concat(F.lit(',"user":'), json_string("user_id"))
    ).otherwise(F.lit(""))
    details = F.when(
        F.size("extra") > 0, F.concat(F.lit(',"details":'), json_object("extra"))
    ).otherwise(F.lit(""))
    record = F.concat(
        F.lit('{"time":"'), rfc3339("time"), F.lit('","layer":'), json_string("layer"),
        F.lit(',"z":'), F.col("z").cast("string"), F.lit(',"x":'), F.col("x").cast("string"),
        F.lit(',"y":'), F.col("y").cast("string"), user, details, F.lit("}"),
    )
    cut = chunk(events, [], ["time", "event_id"], max_size)
    return cut.groupBy("chunk").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.concat(
            F.lit("["),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("pos", record.alias("e")))), lambda s: s["e"]
                ),
                ",",
            ),
            F.lit("]"),
        ).alias("payload"),
    )
