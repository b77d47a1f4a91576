import glob
import gzip
import hashlib
import random

import pytest

from tessera.llm import warc as w
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def rows_of(seed=1):
    rng = random.Random(seed)
    texts = ["x" * 99, "x" * 100, "é" * 60, "", None, "\r\n\r\nWARC/1.1\r\n" * 30, "0\r\n\r\n" * 50, "y" * 70_000, "long " * 40_000]
    rows = [(i, f"http://h/{i}", rng.choice(texts)) for i in range(60)]
    return rows + [(None, "http://n", "x" * 100), (None, None, "z" * 500), (3, "http://a\r\nb", "q" * 200), (61, None, "q" * 200), rows[1], rows[1]]


def expected(rows):
    big = 1 << 62
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [big if p is None else p for p, _, h in rows if (h or "").encode() == data]
        first, own = min(same), big if page is None else page
        again = len(data) >= 100 and own != first
        refers = (None if first == big else first) if again else None
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", refers))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("segment", [200, 1000, 1 << 16])
def test_round_trip(spark, tmp_path, segment):
    rows = rows_of()
    if segment < 1000:
        rows = [r for r in rows if len(r[2] or "") < 90_000]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).selectExpr("*", "1 as name", "2 as digest")
    path = str(tmp_path / "warc")
    w.write_archives(pages, path, segment=segment, records_per_file=7)
    assert len(glob.glob(path + "/part-*")) > 5
    read = w.read_archives(spark, path).cache()
    got = w.resolved(read).select("page_id", "payload_bytes", "payload_digest", "kind", "refers_to", "valid").collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected(rows), key=key)
    assert all(r.valid for r in got)
    whole = sorted((bytes(r.payload) for r in read.where("kind = 'response'").collect()))
    assert whole == sorted((h or "").encode() for (_, _, h), e in zip(rows, expected(rows)) if e[3] == "response")


def test_archive_bytes_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x", "a" * 300), (2, "http://y", "a" * 300)], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    w.write_archives(pages.coalesce(1), path, segment=150)
    data = b"".join(gzip.open(f).read() for f in sorted(glob.glob(path + "/part-*")))
    found = list(w.parse(data))
    assert [f["warc-type"] for f, _ in found].count("continuation") == 2
    first = next(f for f, _ in found if f["warc-type"] == "response")
    last = next(f for f, _ in found if "warc-segment-total-length" in f)
    assert last["warc-segment-origin-id"] == first["warc-record-id"]
    blocks = [b for f, b in found if f["warc-type"] != "revisit"]
    assert int(last["warc-segment-total-length"]) == sum(map(len, blocks))
    again = next(f for f, _ in found if f["warc-type"] == "revisit")
    assert again["warc-refers-to"] == first["warc-record-id"] and again["warc-page-id"] == "2"


def test_broken_segments_are_reported(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "b" * 900), (2, "u", "c" * 900), (3, "u", "d" * 9)], "page_id long, url string, html string")
    path = str(tmp_path / "warc")
    w.write_archives(pages, path, segment=300)
    records = w.read_records(spark, path)
    origin = records.where("page_id = 1").first().name
    lost = records.where(f"not (origin = '{origin}' and number = 2 and origin is not null) or origin is null")
    out = {r.page_id: r for r in w.decoded(w.reassembled(lost)).collect()}
    assert not out[1].valid and out[1].payload is None and out[2].valid and bytes(out[3].payload) == b"d" * 9


def test_chunked_framing():
    for n in (0, 1, 7, 8, 9, 100):
        data = bytes(range(n))
        assert w.unchunked(w.chunked(data, 8)) == data
    assert w.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            w.unchunked(broken)


def test_whole_table_and_sql(spark):
    assert compare(spark, connect(SF), SF, w.op1_warc, w.SQL["op1_warc"]) is None


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    w.write_archives(pages, str(tmp_path / "warc"))
    assert w.read_archives(spark, str(tmp_path / "warc")).count() == 0
