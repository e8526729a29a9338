"""WARC archives written with an index first, and read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentilake.llm.byte_ranges import GAP_BYTES, READ_BYTES, by_region, file_system, read_entries
from sentilake.llm.common import bounded_batches, scratch, stored

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEWLINE = "\r\n"
END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"

FILE_BYTES = 64 << 20
RECORD_ID = "urn:x-record:"
INDEX = "record_id string, url string, digest string, kind string, path string, offset long, length long"
READ = "record_id string, url string, kind string, digest string, refers_to string, payload_bytes long, payload binary"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: four times ten hex digits become eight base32 digits."""
    digest = F.sha1(data)
    digits = F.concat(
        *[F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    )
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def header_value(text: Column) -> Column:
    """Line breaks would break a header: they are percent-encoded."""
    for char, code in (("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def uri_part(identifier: Column) -> Column:
    """An id as part of a URI: null as ``null``, and anything that a URI or a header cannot hold percent-encoded."""
    text = identifier.cast("string")
    return F.when(text.isNull(), "null").when(text == "null", "%6Eull").otherwise(F.url_encode(text))


def _revisits(pages: DataFrame, id_column: str, body_column: str) -> DataFrame:
    """Pages that repeat a payload: (id, digest, first_id). Of equal payloads the one with the largest id is kept whole.

    Digests meet their winner in a join on the digest: pages' counts are combined before the shuffle, and
    adaptive skew handling splits the rows of a payload that very many pages share. Both sides are stored first so
    that it can.
    """
    keyed = stored(
        pages.select(
            F.col(id_column).alias("id"),
            F.octet_length(F.coalesce(F.col(body_column), F.lit(""))).cast("long").alias("size"),
            base32_sha1(F.coalesce(F.col(body_column), F.lit(""))).alias("digest"),
        ),
        "warc-digests",
    )
    winners = keyed.groupBy("digest", "size").agg(F.max("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    shared = stored(winners.filter("n > 1").select("digest", "size", "first_id"), "warc-shared")
    # Only pages that share a payload become revisits; ids are narrow, so the pages join by id.
    revisits = keyed.join(shared, ["digest", "size"]).filter("NOT (id <=> first_id)").select("id", "digest", "first_id")
    return revisits.distinct()


def _typed(pages: DataFrame, revisits: DataFrame, id_column: str, url_column: str, body_column: str) -> DataFrame:
    body = F.coalesce(F.col(body_column), F.lit(""))
    rows = pages.select(
        F.col(id_column).alias("id"),
        header_value(F.col(url_column)).alias("url"),
        body.alias("body"),
        base32_sha1(body).alias("digest"),
        F.octet_length(body).alias("size"),
    ).alias("p")
    joined = rows.join(revisits.alias("r"), F.expr("p.id <=> r.id AND p.digest = r.digest"), "left")
    return joined.select("p.*", "r.first_id", F.col("r.digest").isNotNull().alias("again"))


def _record_head(row: DataFrame) -> DataFrame:
    """Add ``head``: all of the record but its payload and its end."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + NEWLINE + "Content-Type: text/html; charset=utf-8" + NEWLINE + "Content-Length: "),
        F.col("size").cast("string"),
        F.lit(END),
    )
    block = F.octet_length(http) + F.when(F.col("again"), 0).otherwise(F.col("size"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit(NEWLINE))

    record_id, refers = uri_part(F.col("id")), uri_part(F.col("first_id"))
    head = F.concat(
        F.lit(VERSION + NEWLINE),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<" + RECORD_ID), record_id, F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            F.col("again"),
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", F.concat(F.lit("<" + RECORD_ID), refers, F.lit(">"))),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(NEWLINE),
        http,
    )
    return row.withColumn("head", head)


def write_warc(
    pages: DataFrame,
    path: str,
    id_column: str = "page_id",
    url_column: str = "url",
    body_column: str = "html",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the pages as WARC files, one gzip member a record, and return their index (stored as Parquet beside them).

    Pages are not shuffled: each task writes files of its own, under names no other attempt uses, and sends
    record, URL, digest, kind, path, offset and length of what it wrote. Spark commits that table, so files of
    lost attempts are never named. A file ends with the record that takes it past ``file_bytes``.

    Null bodies are empty payloads, null URLs leave the header out, line breaks in URLs are percent-encoded. Of equal
    payloads the largest id is the response, all others are revisits without payload; rows that repeat the largest id
    are all responses. Other columns of the pages are not archived. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    revisits = stored(_revisits(pages, id_column, body_column), "warc-revisits")
    typed = _record_head(_typed(pages, revisits, id_column, url_column, body_column))
    system, inner = file_system(path)
    system.create_dir(f"{inner}/records", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = f"{path}/records/{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}"
        out, name, offset, files = None, "", 0, 0
        for batch in batches:
            entries = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("head", "body", "again")], strict=True)
            for head, body, again in rows:
                if out is None:
                    name, offset, files = f"{prefix}-{files:05d}.warc.gz", 0, files + 1
                    system, inner = file_system(name)
                    out = system.open_output_stream(inner, compression=None)
                record = (head + ("" if again else body) + END).encode()
                packer = zlib.compressobj(wbits=31)
                member = packer.compress(record) + packer.flush()
                out.write(member)
                entries.append((name, offset, len(member)))
                offset += len(member)
                if offset > file_bytes:
                    out.close()
                    out = None
            names, offsets, lengths = zip(*entries, strict=True) if entries else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("record_id", "url", "digest", "kind")]
                + [pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["record_id", "url", "digest", "kind", "path", "offset", "length"],
            )
        if out is not None:
            out.close()

    kind = F.when(F.col("again"), "revisit").otherwise("response").alias("kind")
    rows = typed.select(F.col("id").cast("string").alias("record_id"), "url", "digest", kind, "head", "body", "again")
    rows.mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return open_index(spark, path)


def _parse(member: bytes) -> tuple:
    record = zlib.decompress(member, 31)
    head, _, block = record.partition(END.encode())
    lines = head.decode("utf-8").split(NEWLINE)
    if lines[0] != VERSION:
        raise ValueError("no WARC record at this offset")
    named = dict(line.split(": ", 1) for line in lines[1:])
    size = int(named["Content-Length"])
    if block[size:] != END.encode():
        raise ValueError("the record's length differs from its index entry")
    http, _, payload = block[:size].partition(END.encode())
    stated = int(http.decode("ascii").rsplit("Content-Length: ", 1)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = named["WARC-Type"]
    if kind == "response" and (stated != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("the payload differs from its digest")

    def plain(uri: str | None) -> str | None:
        value = uri and uri.strip("<>").removeprefix(RECORD_ID)
        return None if value is None or value == "null" else unquote_plus(value)

    return (
        plain(named["WARC-Record-ID"]), named.get("WARC-Target-URI"), kind, digest, plain(named.get("WARC-Refers-To")), stated,
        payload if kind == "response" else None,
    )


def read_records(selected: DataFrame, payload: bool = True, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """Read the records that index entries name.

    Entries are dealt to tasks by file and byte region, sorted by offset, and neighbours closer than ``gap`` bytes are fetched in one read
    of at most ``most`` bytes. Payloads are checked against their digest. Revisits have a null payload; with
    ``payload=False`` it is left out for all.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (
            row for b in batches for row in zip(*[b.column(c).to_pylist() for c in ("path", "offset", "length")], strict=True)
        )
        schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("kind", pa.string()), ("digest", pa.string()),
                            ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for read in read_entries(entries, gap, most):
            rows = [_parse(data) for _, data in read]
            if not payload:
                rows = [(*r[:-1], None) for r in rows]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return by_region(selected, ["path", "offset", "length"]).mapInArrow(fetch, READ)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def new_archive(spark: SparkSession) -> str:
    return scratch(spark, "warc")
