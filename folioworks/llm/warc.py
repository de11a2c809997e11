"""Operator 12: revisit resolution in web archives.

``write_archives`` writes WARC records with Spark's text sink: a record is a row, the four
bytes that end a record are the line separator, and task commits make the files whole.
``read_archives`` reads files as binaries and parses each in the task that has it, record by
record. ``deduplicated`` shuffles record headers by payload digest, takes the first record of each
digest as the original, joins all others (and revisit records that the archives hold
already) to it, and writes archives with fresh headers, in which only originals have their
payload. ``resolved`` joins the revisit records of an archive to the responses they name.
Payloads move once, when the archive is rewritten; the join beforehand moves headers alone,
and the rows of a very frequent payload are dealt out by a salt.

Edge cases: a null payload is empty; equal payloads are those of one SHA-1; of rows with one
page id and one payload (repeated rows) one is the response; a null id comes after all others;
a null address is an empty one; an empty table gives an empty archive and result; payloads
of any length are read whole (one record is in memory at a time, and one compressed archive,
which Spark bounds at 2 GB); columns of other names play no part. A damaged archive is an
error that names the file and the place. Records that are neither response nor revisit stay
as they are; a revisit record whose original is in no archive keeps its reference.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut, discard_at_exit, shared_path
from .common import join_groups

#: Fixed values of the WARC format: the profile of revisits with identical payloads, the end of a record, base32.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of an archive file at most.
PER_FILE = 2000
CREATED = "1970-01-01T00:00:00Z"
#: Header fields that become columns; the rest stays in the map ``fields``.
COLUMNS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "uri": "WARC-Target-URI", "date": "WARC-Date", "page_id": "Page-ID", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "refers_to_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date", "profile": "WARC-Profile"}
RECORD = "file string, place long, " + ", ".join(f"{c} string" for c in COLUMNS) + ", fields map<string,string>, http binary, payload_bytes long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 5 hex digits of 40 are 4 of its 32 letters."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substr(F.sha1(payload), g * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, s: F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda v: F.concat(*(letter(v, s) for s in (15, 10, 5, 0)))), "")


def header_line(name: str, value: Column) -> Column:
    """A header field's line; empty for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def record_text(payload: Column, http: Column, more: Column, **fields: Column) -> Column:
    """The whole record but for its end, as text: version, fields by names of COLUMNS, more lines, length, block."""
    length = header_line("Content-Length", F.octet_length(http) + F.octet_length(payload))
    return F.concat(F.lit("WARC/1.1\r\n"), *(header_line(COLUMNS[c], v) for c, v in fields.items()), more, length, F.lit("\r\n"), http, payload)


def write_records(records: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """records' one text column, as compressed archives: level 3 takes half the time of the usual level 6 for files a twentieth larger."""
    records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "THREE").option("maxRecordsPerFile", per_file).text(path)


def http_head(payload: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", date: str = CREATED, per_file: int = PER_FILE) -> None:
    """A response record for each row of pages, in archives below path."""
    rows = pages.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("uri"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    body = F.col("body")
    kind = header_line("Content-Type", F.lit("application/http; msgtype=response"))
    text = record_text(body, http_head(body), kind, type=F.lit("response"), record_id=F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), uri=F.col("uri"), date=F.lit(date), page_id=F.col("key"), digest=F.concat(F.lit("sha1:"), base32_sha1(body)))
    write_records(rows.select(text.alias("value")), path, per_file)


def parsed(name: str, content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header fields, block) of each record of one archive, compressed or not; one block is in memory at a time."""
    raw: io.BufferedIOBase = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        raw = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
    place = 0

    def damaged(why: str) -> ValueError:
        return ValueError(f"{name}: record {place} {why}")

    try:
        while True:
            line = raw.readline(1 << 16)
            while line in (b"\r\n", b"\n"):
                line = raw.readline(1 << 16)
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise damaged("has no version line")
            fields: dict[str, str] = {}
            last = ""
            while (line := raw.readline(1 << 20)) not in (b"\r\n", b"\n"):
                if not line.endswith(b"\n"):
                    raise damaged("ends within its header")
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text[:1] in " \t" and last:  # a folded line goes on with the field before
                    fields[last] += " " + text.strip()
                    continue
                field, colon, value = text.partition(":")
                if not colon:
                    raise damaged("has a header line without a colon")
                last = field.strip().lower()
                fields[last] = value.strip()
            size = fields.get("content-length", "")
            if not size.isascii() or not size.isdigit():
                raise damaged("has no length")
            block = raw.read(int(size))
            if len(block) < int(size):
                raise damaged("ends within its block")
            yield place, fields, block
            place += 1
    except (EOFError, OSError) as e:
        raise damaged(f"cannot be read: {e}") from e


def split_http(fields: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """(HTTP headers with the empty line, payload) of a record's block; blocks of other kinds are payload alone."""
    if "application/http" not in fields.get("content-type", ""):
        return b"", block
    head, end, payload = block.partition(b"\r\n\r\n")
    return (head + end, payload) if end else (block, b"")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of all archives below path; without payloads, their columns stay null but digests and lengths are of the whole payload.

    digest is computed from the payload of responses, and the header's of revisits.
    """
    names = {v.lower(): k for k, v in COLUMNS.items()}
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), *((c, pa.string()) for c in COLUMNS), ("fields", pa.map_(pa.string(), pa.string())), ("http", pa.binary()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch["path"][i].as_py()
                for place, fields, block in parsed(name, batch["content"][i].as_py()):
                    http, payload = split_http(fields, block)
                    row = {"file": name, "place": place, **{c: fields.get(f) for f, c in names.items()}, "fields": [(k, v) for k, v in fields.items() if k not in names and k != "content-length"]}
                    row |= {"http": http, "payload_bytes": len(payload), "payload": payload if payloads else None}
                    row["digest"] = (row["digest"] or "").rpartition(":")[2].upper() or None
                    if row["type"] == "response":
                        row["digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append(row)
                    held += 500 + (len(payload) if payloads else 0)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(parse, RECORD)


def originals(headers: DataFrame, least: int = 0) -> DataFrame:
    """(digest, first, n): of every payload that more than one record has, the first response, and how many records have the digest.

    First is the smallest page id as a number, then date and record id. Payloads below
    least bytes have no row, and neither have digests without a response.
    """
    response = F.col("type") == "response"
    number = F.col("page_id").try_cast("long")
    first = F.struct(number.isNull().alias("none"), number.alias("number"), *(F.col(c) for c in ("date", "record_id", "file", "place", "uri", "payload_bytes")))
    each = headers.where(F.col("digest").isNotNull() & F.col("type").isin("response", "revisit"))
    found = each.groupBy("digest").agg(F.min(F.when(response, first)).alias("first"), F.count("*").alias("n"))
    return found.where(F.col("first").isNotNull() & (F.col("n") > 1) & (F.col("first.payload_bytes") >= least))


def decided(headers: DataFrame, least: int = 0) -> DataFrame:
    """(file, place, to_id, to_uri, to_date) of the records that are revisits of a response in the archives. headers are written already."""
    first = cut(originals(headers, least).select("digest", "n", *(F.col(f"first.{c}").alias(f"to_{c}") for c in ("file", "place", "record_id", "uri", "date"))))
    rows = headers.where(F.col("digest").isNotNull() & F.col("type").isin("response", "revisit")).select("file", "place", "digest")
    met = join_groups(rows, first, "digest", "n").where("file <> to_file or place <> to_place")
    return met.select("file", "place", F.col("to_record_id").alias("to_id"), "to_uri", "to_date")


def deduplicated(spark: SparkSession, source: str, target: str, least: int = 0, per_file: int = PER_FILE) -> None:
    """Archives below target with the records of those below source, each payload once.

    A revisit keeps address, date and HTTP headers of its record, has an id of its own and
    names its original's id, address and date.
    """
    headers = cut(read_archives(spark, source, False).select("file", "place", "type", "record_id", "uri", "date", "page_id", "digest", "payload_bytes"))
    again = cut(decided(headers, least)).hint("shuffle_hash")
    rows = read_archives(spark, source).join(again, ["file", "place"], "left")
    revisit = F.col("to_id").isNotNull()
    kept = lambda c, now: F.when(revisit, now).otherwise(F.col(c))
    payload = F.when(revisit, "").otherwise(F.col("payload").cast("string"))
    rest = F.filter(F.map_entries("fields"), lambda e: ~(revisit & (e["key"] == "warc-block-digest")))
    more = F.array_join(F.transform(rest, lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n"))), "")
    fresh = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    text = record_text(
        payload, F.col("http").cast("string"), more, type=kept("type", F.lit("revisit")), record_id=kept("record_id", fresh), uri=F.col("uri"), date=F.col("date"), page_id=F.col("page_id"),
        digest=F.concat(F.lit("sha1:"), F.col("digest")), refers_to=kept("refers_to", F.col("to_id")), refers_to_uri=kept("refers_to_uri", F.col("to_uri")), refers_to_date=kept("refers_to_date", F.col("to_date")), profile=kept("profile", F.lit(PROFILE)),
    )
    write_records(rows.select(text.alias("value")), target, per_file)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, digest, type, refers_to_page): each revisit with what its response has; records are written already, others have null."""
    named = records.where("type = 'revisit'").groupBy(F.col("refers_to").alias("of")).agg(F.count("*").alias("n"))
    response = records.where("type = 'response'").select(F.col("record_id").alias("of"), F.col("payload_bytes").alias("whole"), F.col("page_id").alias("refers_to_page"))
    groups = cut(named.where("of is not null").join(response, "of", "left"))
    revisits = join_groups(records.where("type = 'revisit' and refers_to is not null").withColumn("of", F.col("refers_to")), groups, "of", "n")
    columns = ["page_id", "payload_bytes", "digest", "type", "refers_to_page"]
    rest = records.where("not (type = 'revisit' and refers_to is not null)").withColumn("refers_to_page", F.lit(None).cast("string"))
    return revisits.withColumn("payload_bytes", F.col("whole")).select(*columns).unionByName(rest.select(*columns))


def op12_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, lean = shared_path(spark), shared_path(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), raw)
    discard_at_exit(spark, raw)
    deduplicated(spark, raw, lean)
    discard_at_exit(spark, lean)
    records = cut(read_archives(spark, lean, False).select("type", "record_id", "page_id", "digest", "refers_to", "payload_bytes"))
    out = resolved(records)
    number = lambda c: F.col(c).cast("long")
    return out.select(number("page_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to_page").alias("refers_to"))


OP12_SQL = f"""
WITH sized AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS r, first(page_id) OVER (PARTITION BY hex ORDER BY page_id NULLS LAST) AS original FROM sized)
SELECT page_id, payload_bytes, array_to_string([substr('{BASE32}', ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
    CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN original END AS refers_to FROM ranked"""
