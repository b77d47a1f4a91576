"""Layer-name patterns such as ``storm_{version}``.

A pattern is compiled on the driver to one regular expression.  Each literal is
taken at its first occurrence and never retried, which atomic groups express
exactly; a lazy group alone would backtrack and accept more names.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tiles import as_col


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class LayerPattern:
    text: str
    regex: str
    names: tuple[str, ...]
    prefix: str

    @property
    def is_literal(self) -> bool:
        return not self.names


def _java_quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def compile_pattern(pattern: str) -> LayerPattern:
    names: list[str] = []
    regex = [r"(?s)\A"]
    prefix = ""
    pending = False
    rest = pattern
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            literal = _java_quote(head)
            regex.append(f"(?>(.*?){literal})" if pending else literal)
            prefix = prefix or ("" if names else head)
            pending = False
        if not brace:
            break
        if pending:
            raise PatternError("two placeholders need a separator between them")
        name, close, rest = tail.partition("}")
        if not close:
            raise PatternError("missing }")
        if name in names:
            raise PatternError(f"placeholder {name!r} is used twice")
        names.append(name)
        pending = True
    regex.append(r"(.*)\z" if pending else r"\z")
    return LayerPattern(pattern, "".join(regex), tuple(names), prefix)


def pattern_matches(name, pattern: LayerPattern) -> Column:
    name = as_col(name)
    if pattern.is_literal:
        return name == pattern.text
    matched = name.rlike(pattern.regex)
    # The cheap prefix test spares most rows the regular expression.
    return (name.startswith(pattern.prefix) & matched) if pattern.prefix else matched


def match_layer(name, pattern: LayerPattern) -> Column:
    """``MAP<STRING,STRING>`` of placeholder values, null when the name differs."""
    name = as_col(name)
    entries: list[Column] = []
    for k, placeholder in enumerate(pattern.names, 1):
        entries += [F.lit(placeholder), F.regexp_extract(name, pattern.regex, k)]
    values = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return F.when(pattern_matches(name, pattern), values)


def anchored_rule(rule: str) -> str:
    """Add a missing ``^`` or ``$``; a final ``$`` means the very end of the text."""
    if not rule:
        raise PatternError("an empty rule is not allowed")
    start = rule if rule[0] == "^" else "^" + rule
    if start[-1] != "$":
        return start + r"\z"
    escaped = (len(start) - 1 - len(start[:-1].rstrip("\\"))) % 2 == 1
    return start if escaped else start[:-1] + r"\z"


def params_valid(params, rules: Mapping[str, str] | None) -> Column:
    """Check matched values; ``*`` tests all, an absent name is tested as ''."""
    params = as_col(params)
    verdict = F.lit(True)
    for key, rule in sorted((rules or {}).items()):
        regex = anchored_rule(rule)
        if key == "*":
            verdict = verdict & F.forall(F.map_values(params), lambda v: F.rlike(v, F.lit(regex)))
        else:
            value = F.coalesce(F.try_element_at(params, F.lit(key)), F.lit(""))
            verdict = verdict & value.rlike(regex)
    return verdict
