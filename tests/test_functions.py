"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import access as a
from tessera.functions import keys as k
from tessera.functions import tiles as t
from tessera.functions.patterns import PatternError, anchored_rule, compile_pattern, match_layer, params_valid
from tessera.functions.urls import expand_url, redact_url, rewrite_wms
from tessera.sources.events import header_name, json_object

L = F.lit


def box(s, n, w, e, srid=4326):
    return t.bounds(L(float(s)), L(float(n)), L(float(w)), L(float(e)), srid)


def test_tile_bounds(value):
    b = value(t.tile_bounds(L(8), L(132), L(85)))
    assert b["south"] == pytest.approx(50.736455, abs=1e-6)
    assert b["north"] == pytest.approx(51.618016, abs=1e-6)
    assert (b["west"], b["east"]) == (5.625, 7.03125)
    world = value(t.tile_bounds(L(0), L(0), L(0)))
    assert world["north"] == pytest.approx(85.0511, abs=1e-4)
    assert (world["west"], world["east"]) == (-180, 180)
    assert value(t.tile_bounds(L(2), L(0), L(5))) is None


@pytest.mark.parametrize(
    "z,x,y,srid,error",
    [(2, 0, 5, 4326, "Y"), (2, 4, 0, 4326, "X"), (2, 4, 9, 4326, "X"), (22, 0, 0, 4326, "Z"),
     (-1, 0, 0, 4326, "Z"), (1, 9, 0, 1234, "SRID"), (21, 2**21 - 1, 0, 3857, None)],
)
def test_tile_error(value, z, x, y, srid, error):
    assert value(t.tile_error(L(z), L(x), L(y), srid)) == error


def test_ewkt(value):
    got = value(t.bounds_ewkt(t.tile_bounds_3857(L(2), L(1), L(1))))
    assert got == (
        "SRID=3857;POLYGON((-10018754.1713945 0.0000000,-10018754.1713945 10018754.1713945,"
        "0.0000000 10018754.1713945,0.0000000 0.0000000,-10018754.1713945 0.0000000))"
    )


def test_wkt_rounds_half_even(value):
    # 45/256 = 0.17578125 lies exactly between two seven-digit values.
    assert value(t.bounds_wkt(box(0, 1, 0.17578125, 1))).startswith("POLYGON((0.1757812 ")


def test_geohash(value):
    b = value(t.geohash_bounds(L("gbsuv7z")))
    assert b["west"] == pytest.approx(-4.329987, abs=1e-6)
    assert b["east"] == pytest.approx(-4.328613, abs=1e-6)
    assert b["south"] == pytest.approx(48.668060, abs=1e-6)
    assert b["north"] == pytest.approx(48.669434, abs=1e-6)
    gb = value(t.geohash_bounds(L("gb")))
    assert tuple(gb)[:4] == (45.0, 50.625, -11.25, 0.0)
    assert tuple(value(t.geohash_bounds(L(""))))[:4] == (-90, 90, -180, 180)
    assert value(t.geohash_bounds(L("some nonsense"))) is None


def test_predicates(value):
    assert not value(t.bounds_intersect(box(0, 1, 0, 1), box(1, 2, 0, 1)))
    assert value(t.bounds_intersect(box(0, 1, 0, 1), box(0.9, 2, 0, 1)))
    assert value(t.bounds_contain(box(0, 1, 0, 1), box(0, 1 + 5e-9, 0, 1)))
    assert not value(t.bounds_contain(box(0, 1, 0, 1), box(0, 1 + 5e-8, 0, 1)))
    assert value(t.bounds_contain_point(box(0, 1, 0, 1), L(1 + 5e-9), L(0.5)))
    assert value(t.tile_intersects(L(99), L(0), L(0), box(0, 0, 0, 0)))
    assert value(t.tile_intersects(L(99), L(0), L(0), box(0, 1, 0, 1))) is None


def test_buffer_and_confine(value):
    b = value(t.bounds_buffer(box(0, 10, 0, 20), L(0.5)))
    assert tuple(b)[:4] == (-2.5, 12.5, -5.0, 25.0)
    c = value(t.bounds_confine(box(-90, 90, -200, 200)))
    assert tuple(c)[:4] == (-85.0511, 85.0511, -180, 180)


def test_round_trip(spark):
    """Every tile is the one found at its own centre."""
    grid = spark.range(0, 64 * 64).select(
        L(6).alias("z"), (F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y")
    )
    c = t.bounds_centroid(t.tile_bounds("z", "x", "y"))
    found = grid.select("x", "y", t.lonlat_tile(c["x"], c["y"], F.col("z")).alias("f"))
    assert found.where("x <> f.x or y <> f.y").count() == 0


@pytest.mark.parametrize(
    "text,zooms",
    [("0", [0]), ("7-9", [7, 8, 9]), ("3,12,5", [3, 12, 5]), ("6,6-7", [6, 6, 7]), ("9-7", None), ("seven", None), ("3,x", None),
     ("-4", None), ("40", None), ("7-40", None), ("-4-7", None), ("", None), ("3,,5", None)],
)
def test_zooms(value, text, zooms):
    assert value(t.zoom_list(L(text))) == zooms
    if zooms is None:
        with pytest.raises(ValueError):
            t.parse_zooms(text)
    else:
        assert t.parse_zooms(text) == zooms


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://maps.test/sea/7/1", "http://maps.test/sea/7/1"),
        ("http://maps.test/get?zoom=7&box=1,2", "http://maps.test/get?box=1%2C2&zoom=7"),
        *((f"http://maps.test/get?{name}=s3cr3t&zoom=7", f"http://maps.test/get?{'&'.join(sorted((name + '=redacted', 'zoom=7')))}")
          for name in ("key", "access_token", "APIKEY", "sig")),
        ("/get?zoom=7&key=s3cr3t", "/get?key=redacted&zoom=7"), ("/get?zoom=7", "/get?zoom=7"),
        ("http://reader:s3cr3t@maps.test/sea", "http://redacted@maps.test/sea"),
        ("http://maps.test/?key=1&key=2&c=%qq&b=x+y", "http://maps.test/?b=x+y&key=redacted"),
        ("http://[fe80::1]:81/sea?b=~*", "http://[fe80::1]:81/sea?b=~%2A"),
        ("http://[fe80::1]x:81/", "(unparseable url)"), (":sea", "(unparseable url)"), ("http://maps.test/%qq", "(unparseable url)"),
    ],
)
def test_redact(value, url, want):
    assert value(redact_url(L(url))) == want


@pytest.mark.parametrize(
    "name,safe",
    [("sea", "sea"), ("sea-2.old", "sea-2.old"), ("../sea", "__sea"), ("..", "_"), (".", "_"), ("......", "_"), ("sea..ice", "sea_ice"),
     ("sea/ice", "sea_ice"), ("früh", "fr_h"), ("море", "____"), ("sea\tice", "sea_ice"), ("sea\r\nice", "sea__ice")],
)
def test_safe_layer(value, name, safe):
    assert value(k.safe_layer(L(name))) == safe


def test_bounded_key(value):
    assert value(k.bounded_key(L("prefix_"), L("osm/20/1/1"))) == "prefix_osm/20/1/1"
    one = value(k.bounded_key(L("p_"), L("a" * 400 + "/20/1/1")))
    two = value(k.bounded_key(L("p_"), L("a" * 400 + "/20/1/2")))
    assert len(one) == len(two) == 250 and one != two and one.startswith("p_aaa")
    long_prefix = value(k.bounded_key(L("p" * 300), L("osm")))
    assert len(long_prefix) == 250 and long_prefix[:233] == "p" * 233


@pytest.mark.parametrize(
    "text,rgba",
    [("FFF", (255,) * 4), ("ffffff", (255,) * 4), ("ffff", (255,) * 4), ("f01", (255, 0, 17, 255)),
     ("aaaa", (170,) * 4), ("01020304", (1, 2, 3, 4)), ("hello", None), ("", None), ("ffffffffff", None), ("#fff", None)],
)
def test_color(value, text, rgba):
    got = value(k.parse_color(L(text)))
    assert (tuple(got) if got else None) == rgba


def test_etag(value):
    tag = k.etag(L(b"hello"))
    text = value(tag)
    assert text.startswith('"2cf24dba') and text.endswith('"')
    for header, want in (("", False), ("*", True), (text, True), (f'"x", W/{text}', True), ('"x"', False), ("x*", False)):
        assert value(k.etag_matches(L(header), tag)) is want


def test_tile_path(value):
    assert tuple(value(k.parse_tile_path(L("/tiles/osm/1/2/3?x=1")))) == ("osm", 1, 2, 3, None)
    assert value(k.parse_tile_path(L("/tiles/osm/1/2/z")))["error"] == "BadRequest"
    assert value(k.parse_tile_path(L("osm/1")))["error"] == "NotFound"
    assert value(k.parse_tile_path(L("/t/osm/-1/2/3")))["z"] == -1


#: Layer names are made from a pattern's pieces, so each case says what it is about.
SURVEY = "survey-{area}-in-{year}.{kind}"


@pytest.mark.parametrize(
    "name,pattern,want",
    [
        ("survey-north bay-in-1998.depth", SURVEY, {"area": "north bay", "year": "1998", "kind": "depth"}),
        ("survey-north bay-in-1998.", SURVEY, {"area": "north bay", "year": "1998", "kind": ""}),
        ("survey--in-.", SURVEY, {"area": "", "year": "", "kind": ""}),
        ("survey-north bay", SURVEY, None), ("my survey-n-in-1.x", SURVEY, None),
        ("survey-n-in-1_x", SURVEY, None),
        ("1998/ice", "{year}/ice", {"year": "1998"}), ("1998/ice cover", "{year}/ice", None),
        ("ice", "ice", {}), ("nice", "ice", None), ("ices", "ice", None), ("ice\n", "ice", None),
        # The first occurrence counts, there is no second try.
        ("ice-1-2-old", "ice-{n}-old", {"n": "1-2"}), ("ice-1-old-old", "ice-{n}-old", None),
        ("ice-1\n2-old", "ice-{n}-old", {"n": "1\n2"}),
        # Signs of regular expressions stand for themselves.
        ("ice+[2]", "ice+[{n}]", {"n": "2"}), ("icee[2]", "ice+[{n}]", None),
    ],
)
def test_patterns(value, name, pattern, want):
    assert value(match_layer(L(name), compile_pattern(pattern))) == want


@pytest.mark.parametrize("bad", ["{year}{month}/ice", "{year}/ice/{year}", "ice-{year", "ice{", "{a}-{b}-{a}"])
def test_bad_patterns(bad):
    with pytest.raises(PatternError):
        compile_pattern(bad)


def test_rules(value):
    values = F.create_map(L("year"), L("1998"), L("area"), L("north"))
    digits, letters = "[0-9]+", "[a-z]+"
    cases = [
        (None, True), ({}, True),
        # One rule for all parameters.
        ({"*": "[0-9a-z]+"}, True), ({"*": "^[0-9a-z]+$"}, True), ({"*": digits}, False),
        # Rules by name; a rule covers the whole value.
        ({"year": digits}, True), ({"year": "[0-9]{3}"}, False), ({"year": digits, "area": letters}, True),
        ({"year": letters}, False), ({"year": digits, "*": "north|1998"}, True), ({"year": digits, "*": "south"}, False),
        # A parameter without a value is empty.
        ({"month": digits}, False), ({"month": "[0-9]*"}, True),
        # Half-anchored alternatives stay half-anchored.
        ({"area": "nor|x"}, True),
    ]
    for rules, want in cases:
        assert value(params_valid(values, rules)) is want, rules
    assert anchored_rule("[0-9]$") == r"^[0-9]\z" and anchored_rule(r"5\$") == r"^5\$"


def fill(value, template, v="x", **kw):
    return value(expand_url(template, L(1), L(1), L(0), F.create_map(L("v"), L(v)), **kw))


def test_values_cannot_leave_their_place(value):
    """Whatever a value holds, it stays in its part of the address."""
    from urllib.parse import parse_qsl, unquote, urlsplit

    for text in ("a/b", "..", "../up", "q?x=1", "h#part", "a&b=2", "100%", "a b", "é", "$1", "1998"):
        parts = urlsplit(fill(value, "http://maps.test/sea/{layer.v}/{z}/{x}/{y}", text))
        path = parts.path.split("/")
        assert (parts.netloc, parts.query, parts.fragment) == ("maps.test", "", "") and path[3:] == ["1", "1", "0"]
        assert len(path) == 6 and unquote(path[2].replace("+", " ")) == text
        parts = urlsplit(fill(value, "http://maps.test/get?name={layer.v}&zoom={z}", text))
        assert parse_qsl(parts.query) == [("name", text), ("zoom", "1")] and not parts.fragment


def test_expand_url(value):
    env = {"HOST": "http://maps.test/v7", "WORD": "k-1"}
    assert fill(value, "{env.HOST}/{z}-{x}-{y}", env=env) == "http://maps.test/v7/1-1-0"
    # Values that look like references are not expanded again.
    again = fill(value, "http://maps.test/{env.WORD}/{ctx.who}/{y}", ctx={"who": L("$2")}, env=env)
    assert again == "http://maps.test/k-1/$2/0"
    assert fill(value, "http://maps.test/x$y/{Z}.{X}.{Y}", invert_y=True) == "http://maps.test/x$y/1.1.1"
    # The upper left corner of the projected world.
    assert fill(value, "{xmin};{ymax}", srid=3857) == "0.000000;20037508.342789"
    assert value(expand_url("{z}/{x}", L(2), L(9), L(0))) is None
    assert rewrite_wms("box=$ymin,$xmax&w=$width&srs=$srs&z=$zoom", 512, 0, 4326) == "box={ymin},{xmax}&w=512&srs=4326&z={z}"
    with pytest.raises(ValueError):
        rewrite_wms("box", srid=27700)


def test_permission(value):
    area = t.tile_bounds(L(10), L(12), L(12))

    def verdict(x, y, layers=None, area=area, partial=False, z=10, layer="osm"):
        allowed = F.array(*[L(v) for v in layers]) if layers else F.array().cast("array<string>")
        return value(a.permission_verdict(L(layer), L(z), L(x), L(y), L(layers is not None), allowed, area, L(partial)))

    assert verdict(12, 12) == "ok"
    assert verdict(10, 10) == "area"
    assert verdict(12, 12, ["osm"]) == "ok"
    assert verdict(12, 12, ["other"]) == "layer"
    assert verdict(3, 3, z=8) == "area" and verdict(3, 3, z=8, partial=True) == "ok"
    assert verdict(-1, 0) == "area"
    assert verdict(-1, 0, area=box(0, 0, 0, 0)) == "ok"


def test_scopes_and_claims(value):
    assert value(a.scope_layers(L("tile/a other tile/b"), "tile/")) == ["a", "b"]
    assert value(a.scope_layers(L("a b"))) == ["a", "b"]
    assert value(a.scope_valid(L("x y"), "y")) and not value(a.scope_valid(L("xy"), "y"))
    assert not value(a.scope_valid(L(None).cast("string"), layer_scope=True))
    assert value(a.scope_valid(L(None).cast("string")))
    assert value(a.claims_valid(L(2000), L(1000)))
    assert not value(a.claims_valid(L(999), L(1000)))
    assert not value(a.claims_valid(L(1000 + 86_401), L(1000)))
    assert not value(a.claims_valid(L(None).cast("long"), L(1000)))
    assert not value(a.claims_valid(L(2000), L(1000), aud=F.array(L("b")), audience="a"))
    assert value(a.claims_valid(L(2000), L(1000), nbf=L(1005)))
    assert not value(a.claims_valid(L(2000), L(1000), nbf=L(1006)))
    assert value(a.claims_valid(L(2000), L(1000), nbf=L(None).cast("long")))


def test_response_policy(value):
    def verdict(status=200, ctype="image/png", declared=10, actual=10, **policy):
        column = a.policy_struct(a.ResponsePolicy(**policy)) if policy else None
        return tuple(value(a.response_verdict(L(status), L(ctype), L(declared), L(actual), column)))

    assert verdict() == (None, "image/png")
    assert verdict(404, "text/html")[0] == "status"
    assert verdict(ctype="text/html")[0] == "content_type"
    assert verdict(declared=-1)[0] == "length"
    assert verdict(declared=-1, unknown_length=True) == (None, "image/png")
    assert verdict(actual=10 * 2**20 + 1)[0] == "length"
    assert verdict(ctype="application/octet-stream", content_types=("application/octet-stream",)) == (None, "")


def test_error_status(value):
    got = {c: value(a.error_status(L(c))) for c in ("auth", "bounds", "provider", "badrequest", "other", "cancelled", "?")}
    assert got == {"auth": 401, "bounds": 400, "provider": 500, "badrequest": 400, "other": 500, "cancelled": 499, "?": 500}
    assert value(a.error_status(L("auth"), True)) == 200


def test_json_and_headers(value):
    extra = F.create_map(L("b"), L('q"uote'), L("bytes"), L("12"), L("duration"), L("x"))
    assert value(json_object(extra)) == '{"b":"q\\"uote","bytes":12,"duration":"x"}'
    assert value(json_object(L(None).cast("map<string,string>"))) == "{}"
    assert header_name("user-AGENT") == "User-Agent" and header_name("bad name") == "bad name"


def test_client_and_names(value):
    assert value(k.client_id(L("u"), L("1"))) == "u"
    assert len(value(k.client_id(L(""), L("10.1.2.3")))) == 64
    assert value(k.client_id(L(""), L(""))) == "anonymous"
    assert value(k.metric_name(L("a.b/c-d_é"))) == "a_b_c-d__"
    assert value(k.remote_ip(L("10.0.0.1:55"))) == "10.0.0.1"
