"""Layer resolution, per-layer policy and layer-reference expansion."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.access import ResponsePolicy, policy_struct
from tessera.functions.patterns import anchored_rule
from tessera.functions.tiles import as_col
from tessera.sources.catalog import Layer, check_catalog

MAX_REFERENCE_DEPTH = 10
#: Catalogs of up to this many layers are broadcast; longer ones are joined as the planner sees fit.
SMALL_CATALOG = 100_000


_PATTERN = (
    "struct<ord:int,id:string,skip_cache:boolean,skip_analytics:boolean,regex:string,"
    "names:array<string>,rules:array<struct<at:int,rule:string>>>"
)


def _rules(layer: Layer) -> list[tuple[int, str]]:
    """(number of the placeholder, rule) pairs; 0 stands for a name the pattern lacks, tested as ''."""
    names, out = list(layer.compiled.names), []
    for key, rule in sorted((layer.active_rules or {}).items()):
        places = range(1, len(names) + 1) if key == "*" else [names.index(key) + 1 if key in names else 0]
        out += [(at, anchored_rule(rule)) for at in places]
    return out


def _group(name: Column, regex: Column, at: Column) -> Column:
    return F.call_function("regexp_extract", name, regex, at)


def resolve_layers(requests: DataFrame, layers: Iterable[Layer], name: str = "layer_name") -> DataFrame:
    """Add the first catalog layer that claims each name (null columns: none does).

    The catalog becomes rows: names without placeholders are looked up by a join
    on the name, patterns by a join on their literal prefix, one for each length
    of prefix, and only patterns of the name's own prefix are tested.  So the plan
    does not grow with the catalog, and no join multiplies rows.  The tables are
    local rows, whose size the planner knows.
    """
    catalog = check_catalog(layers)
    if not catalog:
        raise ValueError("a catalog needs at least one layer")
    spark, column = requests.sparkSession, F.col(name)
    literals: dict[str, tuple] = {}
    prefixes: dict[int, dict[str, list[tuple]]] = {}
    for i, layer in enumerate(catalog):
        pattern, rules = layer.compiled, _rules(layer)
        about = (i, layer.id, layer.skip_cache, layer.skip_analytics)
        if pattern.is_literal and all(re.search(rule.replace(r"\z", r"\Z"), "") for _, rule in rules):
            literals.setdefault(pattern.text, (pattern.text, (*about, "", [], [])))
        elif not pattern.is_literal:
            row = (*about, pattern.regex, list(pattern.names), rules)
            prefixes.setdefault(len(pattern.prefix), {}).setdefault(pattern.prefix, []).append(row)
    hint = F.broadcast if len(catalog) <= SMALL_CATALOG else (lambda df: df)
    table = spark.createDataFrame(list(literals.values()), f"_name string, _literal {_PATTERN}")
    found = requests.join(hint(table), column == F.col("_name"), "left").drop("_name")
    lists = []
    for length, rows in sorted(prefixes.items()):
        table = spark.createDataFrame(list(rows.items()), f"_name string, _tried{length} array<{_PATTERN}>")
        key = F.substring(column, 1, length)
        found = found.join(hint(table), key == F.col("_name"), "left").drop("_name")
        lists.append(f"_tried{length}")

    def claims(p: Column) -> Column:
        def holds(rule: Column) -> Column:
            value = F.when(rule["at"] > 0, _group(column, p["regex"], rule["at"])).otherwise(F.lit(""))
            return F.rlike(value, rule["rule"])

        return F.rlike(column, p["regex"]) & F.forall(p["rules"], holds)

    hits = [F.get(F.filter(c, claims), F.lit(0)) for c in lists]  # lists are in catalog order
    first = F.least(F.col("_literal"), *hits) if hits else F.col("_literal")
    found = found.withColumn("_layer", first).drop("_literal", *lists)
    layer = F.col("_layer")
    values = F.transform(
        F.sequence(F.lit(1), F.size(layer["names"])), lambda k: _group(column, layer["regex"], k)
    )
    values = F.when(F.size(layer["names"]) > 0, values).otherwise(F.array().cast("array<string>"))
    return found.withColumn("layer_params", F.map_from_arrays(layer["names"], values)).select(
        *requests.columns,
        layer["ord"].alias("layer_ord"), layer["id"].alias("layer_id"), "layer_params",
        layer["skip_cache"].alias("skip_cache"), layer["skip_analytics"].alias("skip_analytics"),
    )


def with_policy(
    df: DataFrame,
    layers: Iterable[Layer],
    default: ResponsePolicy = ResponsePolicy(),
    layer_id: str = "layer_id",
) -> DataFrame:
    """Add the ``policy`` struct of each row's layer.

    An override replaces a default unless it is empty or zero; ``unknown_length``
    is never inherited.  The catalog is compiled in as literals, no join needed.
    """
    rows = []
    for layer in check_catalog(layers):
        own = layer.client
        if own is not None:
            rows.append((
                layer.id, list(own.statuses or default.statuses), list(own.content_types or default.content_types),
                own.max_length or default.max_length, own.unknown_length, dict(own.rewrite or default.rewrite),
            ))
    if not rows:
        return df.withColumn("policy", policy_struct(default))
    fields = "statuses array<int>, content_types array<string>, max_length long, unknown_length boolean, rewrite map<string,string>"
    table = df.sparkSession.createDataFrame(rows, f"_layer string, {fields}")
    table = table.select("_layer", F.struct("statuses", "content_types", "max_length", "unknown_length", "rewrite").alias("_policy"))
    if len(rows) <= SMALL_CATALOG:
        table = F.broadcast(table)
    own = F.coalesce(F.col("_policy"), policy_struct(default))
    return df.join(table, F.col(layer_id) == F.col("_layer"), "left").withColumn("policy", own).drop("_layer", "_policy")


def reference_closure(edges: DataFrame, depth: int = MAX_REFERENCE_DEPTH) -> DataFrame:
    """(layer, target, hops, times, error) for every chain of references.

    Chains of more than ``depth`` references are an error: they end in a row with
    ``depth + 1`` hops that says so, as does a chain that comes back to its layer.
    The plan is lazy; chains are put together from halves, so its depth grows with
    the logarithm of ``depth``, and ways to the same target are summed at every
    step.
    """
    step = edges.select("layer", "target", F.lit(1).alias("hops"), F.col("times").cast("long").alias("times"))
    step = step.groupBy("layer", "target", "hops").agg(F.sum("times").alias("times"))

    def follow(first: DataFrame, then: DataFrame) -> DataFrame:
        then = then.select(
            F.col("layer").alias("target"), F.col("target").alias("_to"), F.col("hops").alias("_h"), F.col("times").alias("_n")
        )
        both = first.join(then, "target").groupBy("layer", F.col("_to").alias("target"), (F.col("hops") + F.col("_h")).alias("hops"))
        return both.agg(F.sum(F.col("times") * F.col("_n")).alias("times"))

    exact = {1: step}  # chains of exactly so many hops
    size = 1
    while size * 2 <= depth + 1:
        exact[size * 2] = follow(exact[size], exact[size])
        size *= 2

    def upto(n: int) -> DataFrame:
        if n == 1:
            return step
        half = max(h for h in exact if h < n)
        return upto(half).unionByName(follow(exact[half], upto(n - half)))

    error = F.when(F.col("hops") > depth, F.lit(f"more than {depth} references in a row")).when(
        F.col("layer") == F.col("target"), F.lit("a layer refers to itself")
    )
    return upto(depth + 1).withColumn("error", error)


def expand_refs(requests: DataFrame, edges: DataFrame, layer: str = "layer_id") -> DataFrame:
    """One row per request and layer it reaches: itself (hops 0) and references.

    A chain that is too long or comes back to its layer gives a row with ``ref_error``.
    """
    reach = reference_closure(edges).select(
        F.col("layer").alias(layer), F.col("target").alias("via"), "hops", "times", F.col("error").alias("ref_error")
    )
    own = requests.withColumns(
        {"hops": F.lit(0), "times": F.lit(1).cast("long"), "ref_error": F.lit(None).cast("string")}
    )
    via = requests.join(reach, layer).withColumn(layer, F.col("via")).drop("via")
    return own.unionByName(via)


def expand_pattern(pattern: str, values: Iterable[Mapping[str, str]]) -> list[tuple[int, str]]:
    """Concrete child layers of ``pattern`` in list order."""
    out = []
    for i, row in enumerate(values):
        text = pattern
        for key, value in row.items():
            text = text.replace("{" + key + "}", value)
        out.append((i, text))
    return out


def expand_pattern_column(pattern, values) -> Column:
    """Same as a Column: ARRAY<STRUCT<ord,layer>> from an ARRAY<MAP> column."""

    def one(row, i):
        text = F.aggregate(
            F.map_entries(row),
            as_col(pattern),
            lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
        )
        return F.struct(i.alias("ord"), text.alias("layer"))

    return F.transform(as_col(values), one)
