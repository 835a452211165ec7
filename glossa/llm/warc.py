"""WARC archives with revisit records.

Record headers, without bodies, are shuffled by payload digest; of records with equal payloads one is the response
and the others become revisit records that refer to it by its record id. Bodies join what was found by id and
digest. The deduplicated archives are written with fresh headers, one gzip member for each record, by Spark's own
writer, and read back by a parser that follows Content-Length; revisits join their responses by record id.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, text_or_empty, written

#: Fixed values of the format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary or string column in upper-case base32: each 5 hex digits make 4 of its digits."""
    digits = []
    for i in range(8):
        five = F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digits.append(F.lit(BASE32).substr(F.shiftright(five, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*digits)


def record_id(rid: Column, kind: Column, digest: Column) -> Column:
    seed = F.md5(F.concat_ws(":", F.coalesce(rid.cast("string"), F.lit("")), kind, digest))
    return F.regexp_replace(seed, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def plain_url(url: Column) -> Column:
    """Without white space and control characters, which would end the header."""
    return F.regexp_replace(url.cast("string"), r"[\x00-\x20\x7F]", "")


def resolve(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_bytes: int = 0) -> DataFrame:
    """rid, url, payload, payload_digest, payload_bytes, record_type, refers_to, refers_url: one row per row of pages.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the
    response, others revisit it; smaller ones are all responses. A null payload is an empty one. A null id
    comes after all others: such a record is a response only where no other has its payload. Rows that
    repeat the id of the response and its payload are responses too. Null urls stay out of the headers.
    """
    url = plain_url(F.col(url_col)) if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("rid"), url.alias("url"), text_or_empty(payload_col).alias("payload"))
    rows = rows.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    heads = written(rows.where(F.col("payload_bytes") >= min_bytes).select("rid", "url", "payload_digest"), "heads")
    # Minima and maxima are taken in each task first, so a digest that very many records share is no burden.
    last = heads.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("rid", "url")).alias("x")).where("n > 1")
    last = written(last.select("payload_digest", F.col("x.rid").alias("refers_to"), F.col("x.url").alias("refers_url")), "originals")
    found = heads.join(last, "payload_digest").where(~F.col("rid").eqNullSafe(F.col("refers_to")))
    found = written(found.select(F.col("rid").alias("of"), F.col("payload_digest").alias("digest"), "refers_to", "refers_url").distinct(), "revisits")
    joined = rows.join(found.hint("merge"), F.col("rid").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("digest")), "left")
    kind = F.when(F.col("digest").isNotNull(), "revisit").otherwise("response")
    return joined.withColumn("record_type", kind).drop("of", "digest")


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def records(resolved: DataFrame, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """One row ``value`` per record: fresh WARC headers and block, without the closing pair of line ends.

    The id of a page is kept in the extension field Page-ID.
    """
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    is_response = F.col("record_type") == "response"
    block = F.when(is_response, F.concat(http, F.col("payload"))).otherwise(http)
    block_bytes = F.octet_length(http) + F.when(is_response, F.col("payload_bytes")).otherwise(0)
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", record_id(F.col("rid"), F.col("record_type"), F.col("payload_digest"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(~is_response, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(~is_response, record_id(F.col("refers_to"), F.lit("response"), F.col("payload_digest")))),
        _header("WARC-Refers-To-Target-URI", F.when(~is_response, F.col("refers_url"))),
        _header("WARC-Refers-To-Date", F.when(~is_response, F.lit(date))),
        _header("Page-ID", F.col("rid").cast("string")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF),
    )
    return resolved.select(F.concat(head, block).alias("value"))


def gzip_members(record: bytes, level: int = 6, most: int = 1 << 24) -> bytes:
    """The record as a gzip member; one of 16 MB or more as several, so that each member ends with a zero byte, the last of its size."""
    out = []
    for at in range(0, len(record), most - 1):
        coder = zlib.compressobj(level, zlib.DEFLATED, 31)
        out.append(coder.compress(record[at : at + most - 1]) + coder.flush())
    return b"".join(out)


def write_archives(recs: DataFrame, path: str, file_bytes: int = 32_000_000, level: int = 3) -> None:
    """Files of gzip members, one for each record, of about ``file_bytes`` at most unless a single record is larger.

    Rows of the text writer are runs of members up to a quarter of that. Its line end is the zero byte with which
    every member ends, so that nothing stands between the members and the usual commit protocol holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
        for b in batches:
            for record in b.column(0):
                member = gzip_members(record.as_py() + b"\r\n\r\n", level)
                if held and size + len(member) > file_bytes // 4:
                    yield as_batch()
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield as_batch()

    packed = recs.select(F.col("value").cast("binary")).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", 4).text(path)


def inflated_members(content: bytes) -> bytes:
    """All members of a gzip file, read as a stream: gzip.decompress copies what is left of the file for each of them."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as members:
        return members.read()


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record of one plain archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        at = start + int(headers["Content-Length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's length is wrong, at byte {at}")
        yield headers, view[start:at]
        at += 4


READ_SCHEMA = "record_id string, page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; digest and bytes are those of the payload that was read.

    In revisit records payload and payload_bytes are null and the digest is the one stated. payloads: whether to
    hand the payloads out too.
    """
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    schema = pa.schema([(n, {"payload": pa.binary(), "payload_bytes": pa.int64()}.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                held = 0
                for h, block in parse_archive(inflated_members(content.as_py())):
                    payload = size = None
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response":
                        raw = bytes(block)
                        payload = raw[raw.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((h["WARC-Record-ID"], h.get("Page-ID"), h.get("WARC-Target-URI"), h["WARC-Type"], h.get("WARC-Refers-To"), digest, size, payload if payloads else None))
                    held += len(block) if payloads else 500
                    if held > 8_000_000:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ_SCHEMA)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_bytes: int = 0) -> DataFrame:
    """Writes deduplicated archives in the shared folder and reads them back: one row per page.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to; both payload figures of the full
    payload, which a revisit record takes from the response that it refers to. An empty table writes no
    record and gives an empty result.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(records(resolve(pages, id_col, payload_col, url_col, min_bytes)), path)
    kind = pages.schema[id_col].dataType
    back = written(read_archives(spark, path, payloads=False).drop("payload", "url").withColumn("page_id", F.col("page_id").cast(kind)), "records")
    responses = back.where("record_type = 'response'")
    own = responses.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to"))
    # Rows that repeat the response have its record id too; one of them is enough.
    full = responses.groupBy(F.col("record_id").alias("at")).agg(F.max(F.struct("payload_bytes", "payload_digest", "page_id")).alias("full"))
    full = written(full, "responses")
    revisits = back.where("record_type = 'revisit'").join(full, F.col("refers_to") == F.col("at"))
    revisits = revisits.select(F.col("page_id").alias(id_col), "full.payload_bytes", "full.payload_digest", "record_type", F.col("full.page_id").alias("refers_to"))
    return own.unionByName(revisits)
