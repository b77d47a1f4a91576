"""Layer catalog: an ordered list of layers, configuration that is kept on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.access import ResponsePolicy
from tessera.functions.patterns import LayerPattern, compile_pattern


@dataclass(frozen=True)
class Layer:
    id: str
    pattern: str = ""
    rules: Mapping[str, str] | None = None
    skip_cache: bool = False
    skip_analytics: bool = False
    client: ResponsePolicy | None = None

    @property
    def compiled(self) -> LayerPattern:
        if self.pattern and self.pattern != self.id:
            return compile_pattern(self.pattern)
        return LayerPattern(self.id, "", (), self.id)

    @property
    def active_rules(self) -> Mapping[str, str] | None:
        return self.rules if self.pattern else None


def check_catalog(layers: Iterable[Layer]) -> list[Layer]:
    """The layers in order; a repeated id is an error."""
    out = list(layers)
    seen: set[str] = set()
    for layer in out:
        if layer.id in seen:
            raise ValueError(f"duplicate layer id {layer.id!r}")
        seen.add(layer.id)
    return out


CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("pattern", T.StringType()),
        T.StructField("rules", T.MapType(T.StringType(), T.StringType())),
        T.StructField("skip_cache", T.BooleanType()),
        T.StructField("skip_analytics", T.BooleanType()),
    ]
)


def catalog_frame(spark: SparkSession, layers: Iterable[Layer]) -> DataFrame:
    rows = [
        (i, v.id, v.pattern, dict(v.rules or {}), v.skip_cache, v.skip_analytics)
        for i, v in enumerate(check_catalog(layers))
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def load_catalog(spark: SparkSession, path: str) -> list[Layer]:
    """Catalog from JSON lines with ``ord`` and the ``Layer`` fields."""
    found = spark.read.schema(CATALOG_SCHEMA).json(path).orderBy("ord").collect()  # configuration, read whole
    return check_catalog(
        Layer(r["id"], r["pattern"] or "", r["rules"], bool(r["skip_cache"]), bool(r["skip_analytics"]))
        for r in found
    )


def reference_edges(spark: SparkSession, providers: Mapping[str, object]) -> DataFrame:
    """(layer, target) pairs: which layers a layer's provider settings refer to."""
    edges: list[tuple[str, str]] = []

    def walk(owner: str, node: object) -> None:
        if isinstance(node, Mapping):
            target = node.get("layer")
            if node.get("name") == "ref" and isinstance(target, str) and target:
                edges.append((owner, target))
            for child in node.values():
                walk(owner, child)
        elif isinstance(node, (list, tuple)):
            for child in node:
                walk(owner, child)

    for owner, settings in providers.items():
        walk(owner, json.loads(settings) if isinstance(settings, str) else settings)
    schema = "layer string, target string"
    return spark.createDataFrame(edges, schema).groupBy("layer", "target").agg(
        F.count(F.lit(1)).cast("int").alias("times")
    )
