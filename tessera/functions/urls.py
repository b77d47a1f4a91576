"""Upstream URL templates and credential redaction."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.tiles import (
    WGS84,
    as_col,
    fixed6,
    flip_y,
    let,
    tile_bounds,
    tile_bounds_3857,
)

# Query parameters that carry credentials.
CREDENTIAL_PARAMS = (
    "key",
    "token",
    "apikey",
    "api_key",
    "access_token",
    "password",
    "secret",
    "signature",
    "sig",
)
UNPARSEABLE = "(unparseable url)"

_PLACEHOLDER = re.compile(r"\{(env|ctx|layer)\.([^{}]*)\}|\{([xyzXYZ]|[xy]m(?:in|ax))\}")


def query_escape(v) -> Column:
    """Query escaping that keeps ``-_.~`` and turns blanks into ``+``."""
    return F.replace(F.replace(F.url_encode(v), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def path_escape(v) -> Column:
    """Path-segment escaping; ``$&+=:@`` stay literal, blanks become ``%20``."""
    out = F.replace(query_escape(v), F.lit("+"), F.lit("%20"))
    for code, char in (
        ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%40", "@"),
    ):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def expand_url(
    template: str,
    z,
    x,
    y,
    params=None,
    ctx: Mapping[str, object] | None = None,
    invert_y: bool = False,
    srid: int = WGS84,
    env: Mapping[str, str] | None = None,
) -> Column:
    """Fill an upstream URL template for each tile.

    The template is cut into pieces on the driver and joined by one ``concat``,
    so inserted text is never scanned for placeholders again.  ``params`` is the
    MAP column of a layer-pattern match, ``ctx`` maps names to columns.
    Environment values go in raw; the others are escaped for where they land:
    before the template's first ``?`` as path, after it as query.
    """
    env = os.environ if env is None else env
    z, x, y = as_col(z), as_col(x), as_col(y)
    bounds_of = tile_bounds(z, x, y) if srid == WGS84 else tile_bounds_3857(z, x, y)
    return let(bounds_of, lambda box: _fill(template, z, x, y, box, params, ctx, invert_y, env))


def _fill(template, z, x, y, box, params, ctx, invert_y, env) -> Column:
    row = flip_y(z, y) if invert_y else y
    plain = {
        "z": z.cast("string"),
        "x": x.cast("string"),
        "y": row.cast("string"),
        "xmin": fixed6(box["west"]),
        "xmax": fixed6(box["east"]),
        "ymin": fixed6(box["south"]),
        "ymax": fixed6(box["north"]),
    }
    query_from = template.find("?")
    pieces: list[Column] = []
    at = 0
    for m in _PLACEHOLDER.finditer(template):
        pieces.append(F.lit(template[at : m.start()]))
        at = m.end()
        source, name, tile_field = m.groups()
        if tile_field:
            pieces.append(plain[tile_field if len(tile_field) > 1 else tile_field.lower()])
            continue
        if source == "env":
            pieces.append(F.lit(env.get(name, "")))
            continue
        if source == "ctx":
            value = (ctx or {}).get(name)
            # An absent value prints as the text <nil>.
            value = F.coalesce(as_col(value).cast("string"), F.lit("<nil>")) \
                if value is not None else F.lit("<nil>")
        else:
            value = F.lit("") if params is None else F.coalesce(
                F.try_element_at(as_col(params), F.lit(name)), F.lit("")
            )
        in_query = 0 <= query_from < m.start()
        pieces.append(query_escape(value) if in_query else path_escape(value))
    pieces.append(F.lit(template[at:]))
    return F.when(box.isNotNull(), F.concat(*pieces))


def rewrite_wms(template: str, width: int = 0, height: int = 0, srid: int = 0) -> str:
    """Turn ``$xmin``-style templates into the brace form ``expand_url`` takes."""
    srid = srid or WGS84
    if srid not in (4326, 3857):
        raise ValueError("srid must be 4326 or 3857")
    if not template:
        raise ValueError("a template is required")
    values = {
        "xmin": "{xmin}", "xmax": "{xmax}", "ymin": "{ymin}", "ymax": "{ymax}", "zoom": "{z}",
        "width": str(width or 256), "height": str(height or 256), "srs": str(srid),
    }
    return re.sub(r"\$(" + "|".join(values) + ")", lambda m: values[m.group(1)], template)


# RFC 3986 appendix B, with the scheme held to its legal characters.
_URL = r"\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:(\?)([^#]*))?(?s:#(.*))?\z"


def redact_url(url) -> Column:
    """Mask user info and credential parameters; the query comes back sorted by key."""
    url = as_col(url)

    def group(k):
        return F.regexp_extract(url, _URL, k)

    scheme, authority, path, mark, query, fragment = (group(k) for k in range(1, 7))
    host = F.regexp_replace(authority, r"\A.*@", "")
    bad_escape = r"%(?![0-9A-Fa-f]{2})"
    broken = (
        ~url.rlike(_URL)
        | url.rlike(r"[\x00-\x1f\x7f]")
        | path.rlike(bad_escape)
        | ~host.rlike(r"\A(\[[^\[\]]*\](:[0-9]*)?|[^:\[\]\s]*(:[0-9]*)?)\z")
        | host.rlike(bad_escape)
        | fragment.rlike(bad_escape)
        | ((scheme == "") & (authority == "") & path.rlike(r"\A[^/]*:"))
    )

    def pair(text, i):
        cut = F.instr(text, "=")
        raw_key = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)
        raw_value = F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise(F.lit(""))
        key = F.try_url_decode(raw_key)
        value = F.try_url_decode(raw_value)
        masked = F.lower(key).isin(*CREDENTIAL_PARAMS)
        return F.struct(
            key.alias("k"),
            i.alias("i"),
            F.when(value.isNull(), value)
            .when(masked, F.lit("redacted"))
            .otherwise(value)
            .alias("v"),
            masked.alias("m"),
        )

    texts = F.filter(F.split(query, "&", -1), lambda t: (t != "") & ~t.contains(";"))
    pairs = F.filter(
        F.transform(texts, pair), lambda p: p["k"].isNotNull() & p["v"].isNotNull()
    )
    keys = F.transform(pairs, lambda p: p["k"])
    # Masking replaces every value of a name by one.
    kept = F.filter(pairs, lambda p, i: ~p["m"] | (F.array_position(keys, p["k"]) == i + 1))
    encoded = F.array_join(
        F.transform(
            F.array_sort(kept),
            lambda p: F.concat(query_escape(p["k"]), F.lit("="), query_escape(p["v"])),
        ),
        "&",
    )
    # A bare "?" stays, a query that encodes to nothing goes.
    bare_mark = (mark == "?") & (query == "")
    return F.when(url.isNull(), F.lit(None).cast("string")).when(broken, F.lit(UNPARSEABLE)).otherwise(
        F.concat(
            F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(F.lit("")),
            F.when(
                url.rlike(r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"),
                F.concat(
                    F.lit("//"),
                    F.when(authority.contains("@"), F.lit("redacted@")).otherwise(F.lit("")),
                    host,
                ),
            ).otherwise(F.lit("")),
            path,
            F.when(bare_mark, F.lit("?"))
            .when(encoded != "", F.concat(F.lit("?"), encoded))
            .otherwise(F.lit("")),
            F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
        )
    )
