"""Access-log and application-log sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.keys import parse_tile_path
from tessera.functions.tiles import as_col
from tessera.functions.urls import redact_url

# Apache common log format; combined adds the two quoted texts at the end.
_QUOTED = r'"((?:[^"\\]|\\.)*)"'
_COMMON = r'\A(\S+) (\S+) (.+?) \[([^\]]+)\] ' + _QUOTED + r" ([0-9]{3}) ([0-9]+|-)"
FORMATS = {"common": _COMMON + r"\s*\z", "combined": _COMMON + f" {_QUOTED} {_QUOTED}" + r"\s*\z"}
_MARK = "\x01"
LOG_TIME = "dd/MMM/yyyy:HH:mm:ss Z"


def parse_access_log(lines: DataFrame, fmt: str = "common") -> DataFrame:
    """Typed request rows from log lines (column ``value``).

    ``reject`` says why a line gave no request; see ``split_rejects``.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    # One pass of the expression rewrites a line to its fields, split at a mark
    # that cannot be in a log line; a line that does not match stays one piece.
    groups = 9 if fmt == "combined" else 7
    marked = F.regexp_replace(
        "value", FORMATS[fmt], _MARK.join(f"${k}" for k in range(1, groups + 1))
    )
    split = lines.select("value", F.split(marked, _MARK, -1).alias("f"))

    def field(k):
        return F.get("f", F.lit(k - 1))

    # Quotes inside a request or header are written with a backslash.
    def text(k):
        return F.replace(F.replace(field(k), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))

    matched = F.size("f") == groups
    typed = split.select(
        "value",
        matched.alias("ok"),
        F.when(matched, field(1)).alias("ip"),
        F.when(field(3) == "-", F.lit("")).otherwise(field(3)).alias("user_id"),
        F.try_to_timestamp(field(4), F.lit(LOG_TIME)).alias("time"),
        F.split(text(5), " ", -1).alias("request"),
        field(6).try_cast("int").alias("status"),
        F.coalesce(field(7).try_cast("long"), F.lit(0).cast("long")).alias("bytes"),
        (text(8) if fmt == "combined" else F.lit("")).alias("referer"),
        (text(9) if fmt == "combined" else F.lit("")).alias("user_agent"),
    ).withColumn("uri", F.get("request", F.lit(1))).withColumn("tile", parse_tile_path("uri"))
    reject = (
        F.when(~F.col("ok"), F.lit("format"))
        .when(F.col("time").isNull(), F.lit("time"))
        .when(F.col("uri").isNull(), F.lit("request"))
        .otherwise(F.col("tile.error"))
    )
    row = F.struct(
        "ip", "user_id", "time", F.get("request", F.lit(0)).alias("method"), "uri",
        F.get("request", F.lit(2)).alias("proto"), "status", "bytes", "referer", "user_agent",
        F.col("tile.layer_name").alias("layer_name"), F.col("tile.z").alias("z"),
        F.col("tile.x").alias("x"), F.col("tile.y").alias("y"), reject.alias("reject"),
    )
    # One row in, one out: a filter on the result stays above the parse, which
    # would else be done once for the filter and again for the columns.
    return typed.select("value", F.inline(F.array(row)))


def read_access_log(spark: SparkSession, path: str, fmt: str = "common") -> DataFrame:
    return parse_access_log(spark.read.text(path), fmt)


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the raw line, rejected lines with the reason)."""
    good = parsed.where(F.col("reject").isNull()).drop("value", "reject")
    return good, parsed.where(F.col("reject").isNotNull()).select("value", "reject")


def format_access_log(requests: DataFrame) -> DataFrame:
    """Common-format lines of a request log; the inverse of parsing."""
    user = F.when(F.coalesce("user_id", F.lit("")) == "", F.lit("-")).otherwise(F.col("user_id"))
    stamp = F.date_format("time", "dd/MMM/yyyy:HH:mm:ss")
    path = F.concat_ws("/", F.lit("/tiles"), "layer_name", *[F.col(c).cast("string") for c in "zxy"])
    line = F.concat(
        F.col("ip"), F.lit(" - "), user, F.lit(" ["), stamp, F.lit(' +0000] "GET '), path,
        F.lit(' HTTP/1.1" '), F.col("status").cast("string"), F.lit(" "), F.col("bytes").cast("string"),
    )
    return requests.select(line.alias("value"))


CORRUPT = "_corrupt_record"
_REQUEST_ATTRIBUTES = ("uri", "path", "proto", "ip", "method", "host", "elapsed", "user")


def app_log_schema(headers: Sequence[str] = ()) -> T.StructType:
    """JSON application log: message keys, request attributes, lower-cased headers."""
    text = T.StringType()
    fields = [T.StructField(n, text) for n in ("time", "level", "message")]
    fields += [T.StructField(n, text) for n in _REQUEST_ATTRIBUTES]
    fields.append(T.StructField("query", T.MapType(text, T.ArrayType(text))))
    fields += [T.StructField(h.lower(), text) for h in headers]
    return T.StructType(fields + [T.StructField(CORRUPT, text)])


def read_app_log(spark: SparkSession, path: str, headers: Sequence[str] = ()) -> DataFrame:
    raw = (
        spark.read.schema(app_log_schema(headers))
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return _typed_app_log(raw)


def parse_app_log(lines: DataFrame, headers: Sequence[str] = ()) -> DataFrame:
    """``read_app_log`` for lines already in a column ``value``."""
    options = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    record = F.from_json("value", app_log_schema(headers), options)
    return _typed_app_log(lines.select(record.alias("r")).select("r.*"))


def _typed_app_log(raw: DataFrame) -> DataFrame:
    return raw.withColumn("time", F.col("time").try_cast("timestamp"))


def scrub_log(log: DataFrame, url: str = "uri", hashed: Sequence[str] = ("ip",), dropped: Sequence[str] = ("user_agent",)) -> DataFrame:
    """Redact URLs, replace personal fields by their SHA-256 or drop them."""
    out = log.withColumn(url, redact_url(url))
    for name in hashed:
        value = as_col(name).cast("string")
        out = out.withColumn(name, F.when(value != "", F.sha2(value.cast("binary"), 256)).otherwise(value))
    return out.drop(*dropped)
