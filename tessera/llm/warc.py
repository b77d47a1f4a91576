"""WARC archives: pages written as records, long records in segments, and read back.

**Writing.**  A page is a ``response`` record whose block is an HTTP response with
chunked transfer framing; of pages with equal payloads of at least ``LEAST_EQUAL``
bytes only that with the smallest page_id is, the others are ``revisit`` records
that refer to it.  Blocks longer than ``segment`` bytes are split: the first
segment is in the response, the others in ``continuation`` records that name the
origin and their number, the last one also the total length.  Spark's text sink
writes the records as bytes (a record ends in a line feed, the sink's separator),
so archives are committed like any other table and lie wherever Spark can write.

**Reading.**  Archives are read whole, which ``records_per_file`` bounds, and parsed
by the lengths in their headers.  Records in one piece are decoded in place; only
segments are shuffled, by their origin's id.  They are put in order, the total
length is verified, and the chunked framing is decoded.  A record with a missing
segment, a wrong total or broken framing comes back with ``valid`` false and no
payload.

Equal payloads are found by digest with map-side combining, so a payload that a
third of all pages share is one row per task; pages that cannot be revisits are not
shuffled at all.

Defined results: a null html is an empty payload; rows that share the smallest
page_id of a payload are all responses; a null page_id counts as greatest; repeated
rows are repeated records; control characters in a url are percent-encoded; further
columns of the pages are not archived.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, staged, table
from tessera.session import shared_dir

LEAST_EQUAL = 100
SEGMENT = 64 * 1024
CHUNK = 8 * 1024
RECORDS_PER_FILE = 1000
DATE = "2024-01-01T00:00:00Z"
BUCKETS = 1 << 18

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload in chunked framing; raises ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without end")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP head")
    coding = [x.split(b":", 1)[1] for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"transfer-encoding:")]
    return unchunked(body) if any(b"chunked" in x.lower() for x in coding) else body


def record(kind: str, name: str, block: bytes, **fields: object) -> bytes:
    """One record; fields that are None are left out.  Underscores in field names stand for hyphens."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(name: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers: str | None, segment: int) -> list[bytes]:
    if url is not None:
        url = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
    common = {"WARC_Target_URI": url, "WARC_Page_ID": page_id, "WARC_Payload_Digest": f"sha256:{digest}"}
    if refers is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record("revisit", name, b"", **common, WARC_Profile=profile, WARC_Refers_To=f"<urn:uuid:{refers}>")]
    block = HTTP_HEAD + chunked(payload)
    http = "application/http;msgtype=response"
    if len(block) <= segment:
        return [record("response", name, block, **common, Content_Type=http)]
    out = [record("response", name, block[:segment], **common, Content_Type=http, WARC_Segment_Number=1)]
    count = -(-len(block) // segment)
    for number in range(2, count + 1):
        out.append(record(
            "continuation", str_uuid(f"{name} {number}"), block[(number - 1) * segment : number * segment],
            WARC_Segment_Origin_ID=f"<urn:uuid:{name}>", WARC_Segment_Number=number,
            WARC_Segment_Total_Length=len(block) if number == count else None,
        ))
    return out


def str_uuid(text: str) -> str:
    h = hashlib.sha256(text.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def named_pages(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and ``name``, an id made of page_id, url and digest."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    text = F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest", "url")
    h = F.sha2(text, 256)
    parts = (F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return rows.withColumn("name", F.concat_ws("-", *parts))


def revisits_of(rows: DataFrame, least: int) -> DataFrame:
    """``name`` and ``refers`` of the pages whose payload another page has already."""
    order = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("name"))
    long = rows.where(F.length("payload") >= least).select("digest", "page_id", "name")
    groups = long.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    groups = groups.where(~F.col("first.page_id").eqNullSafe(F.col("last.page_id")))
    groups = staged(groups.select("digest", F.col("first.page_id").alias("to"), F.col("first.name").alias("refers")), "equal")
    again = long.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("to")))
    return staged(again.select("name", "refers").distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = LEAST_EQUAL, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write all pages as gzip-compressed archives below ``path``."""
    small_batches(pages.sparkSession)
    rows = named_pages(pages)
    revisits = revisits_of(rows, least)
    bucket = F.pmod(F.xxhash64("name"), F.lit(BUCKETS))
    marks = F.broadcast(revisits.select(bucket.alias("bucket"), F.lit(True).alias("hit")).distinct())
    marked = rows.withColumn("bucket", bucket).join(marks, "bucket", "left")
    single = marked.where(F.col("hit").isNull()).withColumn("refers", F.lit(None).cast("string"))
    both = single.unionByName(marked.where("hit").join(revisits, "name", "left"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("name", "page_id", "url", "digest", "payload", "refers")]
            out, size = [], 0
            for row in zip(*columns):
                for made in page_records(*row, segment):
                    out.append(made[:-1])  # the sink adds the last line feed
                    size += len(made)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                    out, size = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    records = both.select("name", "page_id", "url", "digest", "payload", "refers").mapInArrow(encode, "value binary")
    writer = records.select(F.col("value").cast("string").alias("value")).write
    writer.options(compression="gzip", maxRecordsPerFile=records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has a wrong length")
        yield fields, block
        at = end + 8 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, continuations included."""
    text = ("name", "kind", "url", "digest", "refers", "origin")
    whole = ("page_id", "number", "total")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                out: dict[str, list] = {c: [] for c in (*text, *whole, "block")}
                size = 0
                for fields, block in parse(data):
                    bare = lambda key: fields.get(key, "")[10:-1] or None  # noqa: B023, E731
                    number = lambda key: int(fields[key]) if key in fields else None  # noqa: B023, E731
                    for name, value in (
                        ("name", bare("warc-record-id")), ("kind", fields["warc-type"]), ("url", fields.get("warc-target-uri")),
                        ("digest", fields.get("warc-payload-digest", "")[7:] or None), ("refers", bare("warc-refers-to")),
                        ("origin", bare("warc-segment-origin-id")), ("page_id", number("warc-page-id")),
                        ("number", number("warc-segment-number")), ("total", number("warc-segment-total-length")),
                        ("block", block),
                    ):
                        out[name].append(value)
                    size += len(block)
                    if size > 8_000_000:
                        yield batch_of(out)
                        out, size = {c: [] for c in out}, 0
                yield batch_of(out)

    def batch_of(out: dict[str, list]) -> pa.RecordBatch:
        kinds = {c: pa.string() for c in text} | {c: pa.int64() for c in whole} | {"block": pa.binary()}
        return pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    kinds = ", ".join([f"{c} string" for c in text] + [f"{c} long" for c in whole])
    return files.mapInArrow(scan, kinds + ", block binary")


def reassembled(records: DataFrame) -> DataFrame:
    """Responses and revisits with their whole blocks, as ``blocks`` in order, and ``segments``.

    ``blocks`` is null where segments are missing or do not have the total length.
    """
    heads = records.where("kind <> 'continuation'")
    single = heads.where("number is null").withColumns({"blocks": F.array("block"), "segments": F.lit(1)})
    first = heads.where("number is not null")
    parts = records.where("number is not null").select(
        F.coalesce("origin", "name").alias("name"), "number", "total", "block"
    )
    grouped = parts.groupBy("name").agg(
        F.sort_array(F.collect_set(F.struct("number", "block"))).alias("parts"), F.max("total").alias("_total")
    )
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.length(x["block"]))
    in_order = F.transform("parts", lambda x: x["number"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    whole = F.when(in_order & (length == F.col("_total")), F.transform("parts", lambda x: x["block"]))
    grouped = grouped.select("name", whole.alias("blocks"), F.size("parts").alias("segments"))
    return single.unionByName(first.join(grouped, "name")).drop("block", "number", "total", "origin")


def decoded(records: DataFrame, payload: bool = True) -> DataFrame:
    """``valid``, ``payload_bytes``, ``payload_digest`` and, if asked for, ``payload`` of each record."""
    kept = ("name", "kind", "url", "digest", "refers", "page_id", "segments")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, sizes, digests, payloads = [], [], [], []
            for kind, digest, blocks in zip(*(batch.column(c).to_pylist() for c in ("kind", "digest", "blocks"))):
                found = None
                if kind == "response" and blocks is not None:
                    try:
                        found = http_payload(b"".join(blocks))
                    except ValueError:
                        found = None
                seen = None if found is None else hashlib.sha256(found).hexdigest()
                ok = kind == "revisit" or (found is not None and digest in (None, seen))
                valid.append(ok)
                sizes.append(len(found) if found is not None and ok else None)
                digests.append(seen if ok else None)
                payloads.append(found if ok and payload else None)
            columns = {c: batch.column(c) for c in kept}
            columns |= {"valid": pa.array(valid, pa.bool_()), "payload_bytes": pa.array(sizes, pa.int64())}
            columns["payload_digest"] = pa.array(digests, pa.string())
            if payload:
                columns["payload"] = pa.array(payloads, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kinds = "name string, kind string, url string, digest string, refers string, page_id long, segments int"
    kinds += ", valid boolean, payload_bytes long, payload_digest string" + (", payload binary" if payload else "")
    return records.select(*kept, "blocks").mapInArrow(decode, kinds)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Responses and revisits of all archives, reassembled, verified and decoded."""
    small_batches(spark)
    return decoded(reassembled(read_records(spark, path)), payload)


def resolved(rows: DataFrame) -> DataFrame:
    """Records with ``refers_to``; a revisit takes size and digest from the response it refers to."""
    own = rows.where("kind = 'response'").select(
        F.col("name").alias("refers"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"),
    )
    again = rows.where("kind = 'revisit'")
    own = own.join(again.select("refers").distinct(), "refers", "left_semi").dropDuplicates(["refers"])
    again = again.join(own, "refers", "left")
    again = again.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest")}).drop("_bytes", "_digest")
    found = F.col("payload_digest").isNotNull() & (F.col("payload_digest") == F.col("digest"))
    again = again.withColumn("valid", found)
    return rows.where("kind <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = resolved(staged(read_archives(spark, path, payload=False), "records"))
    return rows.select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to", "segments", "valid"
    )


QUERIES = {"op1_warc": op1_warc}
SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to,
  CASE WHEN n >= 100 AND page_id <> first THEN 1
    ELSE CAST(ceil((87 + n + 5 + (CASE WHEN n % 8192 = 0 THEN 0 ELSE length(printf('%x', n % 8192)) + 4 END)
      + (n // 8192) * 8) / 65536.0) AS INT) END AS segments,
  true AS valid
FROM g"""
}
