"""WARC: write captures, read them back, assemble transactions.

Each capture is three records: a response (or a revisit of an earlier one with the same
payload), the request and a metadata record.  The last two name the first by WARC-Concurrent-To.

Writing needs no local file: a record is one string and Spark's text sink, with the record
terminator CR LF CR LF as its line separator, writes gzip archives to any store with its usual
commit protocol.  Records are put together to pieces of bounded bytes, and an archive has so many
pieces, so its size does not depend on how the sizes of pages are spread.

Reading takes whole archives as binary rows (their size is bounded by the writer) and parses by
Content-Length, so payloads may hold any bytes.  ``assemble`` joins the records of a transaction
through their identifiers into one nested row a capture.

Equal payloads: of records with the same payload of at least ``REVISIT_FROM`` bytes, the one
with the largest page_id is the response and the others revisit it.

A revisit whose response is not among the records read keeps the digest that it names, the bytes
that it holds itself and no page that it refers to.  Spark's gzip sink makes one member a file, so
readers seek by archive, not by record.

Defined cases: null html is an empty payload; controls in a url are percent-encoded; a null page_id sorts below all others; rows alike
in page_id, url and html are captures of their own (of these one is the response); null urls
become an empty target; pages may be of any length; extra columns play no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import bitmap_of, in_bitmap, materialise, scratch

REVISIT_FROM = 1000
#: Bytes of an archive before compression, and of the pieces that it is made of.
ARCHIVE_BYTES, PIECE = 16 << 20, 1 << 20
END = "\r\n\r\n"
#: Date of captures where pages carry none.
DATE = "2020-01-01T00:00:00Z"


def _uuid(*parts):
    h = F.md5(F.concat_ws("\x1f", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind, ident, uri, headers: list, content_type: str, block):
    """One record without its terminator; headers are (name, column) pairs, left out where null."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def _uri(url):
    """A header holds one line, so controls in a url are percent-encoded."""
    plain = out = F.coalesce(url, F.lit(""))
    for code in (*range(32), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(plain.rlike("[\\x00-\\x1F\\x7F]"), out).otherwise(plain)


def _mark(bitmap):
    def run(batches):
        flags = bitmap.value
        for batch in batches:
            again = in_bitmap(flags, batch.column("key").to_numpy()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(again, pa.bool_())], [*batch.schema.names, "again"])

    return run


def captures(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` with its record type, identifiers and the payload to write."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), _uri(F.col("url")).alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    base = base.withColumn("row_ref", F.md5(F.concat_ws("\x1f", text(F.col("page_id")), "url", "digest"))).withColumn("key", F.xxhash64("digest"))
    # types are settled on rows without payloads; only payloads that occur again are dealt by row
    small = base.groupBy("row_ref", "digest", "key").agg(F.max(F.struct("page_id", "url", "row_ref")).alias("own"), F.max(F.octet_length("html") >= REVISIT_FROM).alias("long"), F.count("*").alias("copies"))
    again = small.groupBy("digest", "key").agg(F.max(F.when(F.col("long"), F.col("own"))).alias("head"), F.sum("copies").alias("n")).where("n > 1")
    again = materialise(again, "payloads")
    flags = pages.sparkSession.sparkContext.broadcast(bitmap_of(again, "key"))
    base = base.mapInArrow(_mark(flags), StructType([*base.schema.fields, StructField("again", BooleanType())]))
    alone = base.where("not again").select("page_id", "url", "html", "digest", "row_ref", F.lit(None).cast(again.schema["head"].dataType).alias("head"), F.lit(1).alias("copy"))
    plan = small.join(again.select("digest", "head"), "digest").select("row_ref", "head")
    rows = base.where("again").drop("key", "again").join(plan, "row_ref", "left").withColumn("copy", F.row_number().over(Window.partitionBy("row_ref").orderBy("row_ref")))
    rows = alone.unionByName(rows)
    revisit = F.col("head").isNotNull() & ~((F.col("row_ref") == F.col("head.row_ref")) & (F.col("copy") == 1))
    ident = _uuid(F.lit("capture"), F.col("row_ref"), F.col("copy").cast("string"))
    head_ident = _uuid(F.lit("capture"), F.col("head.row_ref"), F.lit("1"))
    return rows.select(
        "page_id", "url", ident.alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, head_ident).alias("refers_to"), "digest", F.when(revisit, "").otherwise(F.col("html")).alias("html"),
    )


def records(caught: DataFrame) -> DataFrame:
    """The three WARC records of each capture as strings."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    answer = _record(
        F.col("record_type"), F.col("record_id"), F.col("url"),
        [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Profile", F.when(F.col("refers_to").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))],
        "application/http; msgtype=response", F.concat(http, F.col("html")),
    )
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    request = _record(F.lit("request"), _uuid(F.lit("request"), F.col("record_id")), F.col("url"), [("WARC-Concurrent-To", F.col("record_id"))], "application/http; msgtype=request", F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\n\r\n")))
    note = _record(F.lit("metadata"), _uuid(F.lit("metadata"), F.col("record_id")), F.col("url"), [("WARC-Concurrent-To", F.col("record_id"))], "application/warc-fields", F.concat(F.lit("page_id: "), page, F.lit("\r\n")))
    return caught.select(F.explode(F.array(answer, request, note)).alias("value"))


def _packed(most: int):
    """Records in, pieces of about ``most`` bytes out: whole records, with the separator between them."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for record in batch.column("value"):
                more = record.as_buffer().size
                if held and size + more > most:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.string())], ["value"])
                    held, size = [], 0
                held.append(record.as_py())
                size += more
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.string())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str) -> str:
    """Write the captures of ``pages`` as .warc.gz archives below ``path`` (a folder that must not exist).

    An archive has about ``ARCHIVE_BYTES`` before compression, whatever the sizes of its pages: it is
    cut by pieces of ``PIECE`` bytes, and a record longer than that is a piece of its own.
    """
    pieces = records(captures(pages)).mapInArrow(_packed(PIECE), "value string")
    pieces.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // PIECE)).text(path)
    return path


_RECORD = "kind string, record_id string, uri string, concurrent_to array<string>, refers_to string, payload_digest string, header string, payload binary"
_FIELDS = [x.split()[0] for x in _RECORD.split(", ")]


def parse(data: bytes):
    """Records of one archive as tuples in the order of ``_FIELDS``; wholly by Content-Length."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
        named = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:])]
        fields = dict(named)
        together = [v for k, v in named if k == "warc-concurrent-to"]
        start = head_end + 4
        block = data[start : start + int(fields["content-length"])]
        if not lines[0].startswith("WARC/") or len(block) < int(fields["content-length"]):
            raise ValueError("not a whole WARC record")
        at = start + len(block)
        header, payload = b"", block
        if fields.get("content-type", "").startswith("application/http"):
            header, _, payload = block.partition(b"\r\n\r\n")
        yield (fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri"), together, fields.get("warc-refers-to"), (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None, header.decode("utf-8", "replace"), payload)


def _parse_files(batches):
    schema = pa.schema([(n, pa.binary() if n == "payload" else pa.list_(pa.string()) if n == "concurrent_to" else pa.string()) for n in _FIELDS])
    for batch in batches:
        for raw in batch.column("content"):
            data = raw.as_py()
            if data[:2] == b"\x1f\x8b":
                data = _gunzip(data)
            rows: list[tuple] = []
            for row in parse(data):
                rows.append(row)
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse_files, _RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit, with its request and metadata records.

    A transaction's records share one identifier, so the arrays hold what one exchange with a
    server produced.  Records that name no capture here appear in no row.
    """
    answer = found.where("kind in ('response', 'revisit')").select("record_id", "uri", "kind", "refers_to", "payload_digest", F.struct("header", "payload").alias("response"))
    part = F.struct("record_id", F.col("header"), F.col("payload").alias("block"))
    other = found.where("kind in ('request', 'metadata')").withColumn("to", F.explode(F.array_distinct("concurrent_to"))).groupBy("to").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "request", part))).alias("requests"), F.array_sort(F.collect_list(F.when(F.col("kind") == "metadata", part))).alias("metadata"))
    return answer.join(other, F.col("record_id") == F.col("to"), "left").drop("to")


def _measured(batches):
    names = ["record_id", "kind", "uri", "refers_to", "payload_digest", "page", "payload_bytes", "found_digest"]
    for batch in batches:
        blocks = batch.column("payload")
        data = [x.as_py() or b"" for x in blocks]
        columns = [batch.column(c) for c in names[:6]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha1(x).hexdigest() for x in data], pa.string())], names)


def capture_table(nested: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each assembled capture; digests are computed again from the payloads read."""
    flat = nested.select("record_id", "kind", "uri", "refers_to", "payload_digest", F.regexp_extract(F.col("metadata")[0]["block"].cast("string"), "page_id: ([-0-9]*)", 1).alias("page"), F.col("response.payload").alias("payload"))
    flat = flat.mapInArrow(_measured, "record_id string, kind string, uri string, refers_to string, payload_digest string, page string, payload_bytes long, found_digest string")
    flat = materialise(flat.withColumn("page_id", F.col("page").try_cast("long")).select("record_id", "kind", "refers_to", "payload_digest", "page_id", "payload_bytes", "found_digest", "uri"), "captures")
    revisits = flat.where("kind = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("wanted")).distinct()
    whole = flat.where("kind = 'response'")
    seen = whole.join(wanted, F.col("record_id") == F.col("wanted"), "left_semi").select(F.col("record_id").alias("head"), F.col("page_id").alias("head_page"), F.col("payload_bytes").alias("head_bytes"), F.col("found_digest").alias("head_digest"))
    resolved = revisits.join(seen, F.col("refers_to") == F.col("head"), "left").select("page_id", F.coalesce("head_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("head_digest", "payload_digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("head_page").alias("refers_to"), "uri")
    plain = whole.select("page_id", "payload_bytes", F.col("found_digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "uri")
    return plain.unionByName(resolved)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"))
    return capture_table(assemble(read_archives(spark, path))).drop("uri")
