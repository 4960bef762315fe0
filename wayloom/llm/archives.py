"""Web archives: a converter from legacy ARC files to WARC, with writers and readers of both.

1. `write_arc` writes (url, ip, date, mime, block) rows as ARC files of version 1 or 2, one per partition, so that a file
   holds what a split of the scan holds, and nothing is shuffled.
2. `read_arc` reads any such files, gzipped (in one member or many) or not: the version block tells which fields the
   header line of each document has, and the declared length where its block ends. Blocks may hold anything.
3. `convert` synthesises what WARC has and ARC lacks: record ids (from archive and offset), ISO timestamps, types
   (http responses, version blocks as warcinfo, anything else as resource), block and payload digests.
4. `mark_revisits` turns records whose payload another one has into revisits of it. Payloads are compared by SHA-256
   and length, on rows without payloads; a payload with any number of copies costs a row each.
5. `write_warc` and `read_warc`: WARC 1.1 files, one per partition, whose records are read by their declared lengths.

Files are written by Spark's text writer, whose line separator is the format's own record separator, so they lie where
Spark can write and appear only when their task is done; they are gzipped as a whole, not record by record. A reader
holds one compressed file and one record at a time; the number of files grows with the bytes.

Defined results: a null block is empty; a url that is null or has blanks or control characters is percent-encoded, a
null one is `about:blank`. Of records with equal payloads the one with the greatest `rank` (nulls last), then the
greatest id, stays a response. A record that ends before its declared length, or whose gzip stream breaks off, is kept
as far as it goes and marked truncated; what follows an unreadable header line is left, and the line reported as such.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The fields of a document's header line, by version of the format.
ARC_FIELDS = {1: ["url", "ip", "date", "mime", "length"], 2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"]}
DEFINITION = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20000101000000"  # where a row has none
LEVEL = "BEST_SPEED"  # of gzip; DEFAULT_COMPRESSION takes twice the time and makes files a quarter smaller
LEAST_BYTES = 0  # of a payload that may be revisited
BATCH_BYTES = 4 << 20
RECORD = "record_id string, type string, url string, ip string, date string, mime string, status string, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string, payload_key binary, truncated boolean"
RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _written(records: DataFrame, folder: str, separator: str) -> None:
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option("zlib.compress.level", LEVEL).text(folder, compression="gzip")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files in a folder; a task has as many as make up a split of a scan."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(folder).select("path", "content")


class _Gunzip(io.RawIOBase):
    """The bytes of gzip members one after another, as far as they can be read, in steps of 64 KB."""

    def __init__(self, content: bytes) -> None:
        self.content, self.at, self.member = memoryview(content), 0, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            if self.member.eof:
                self.at -= len(self.member.unused_data)
                self.member = zlib.decompressobj(31)
            part = self.member.unconsumed_tail
            if not part:
                part = self.content[self.at : self.at + (1 << 16)]
                self.at += len(part)
            try:
                out = self.member.decompress(part, len(target))
            except zlib.error:
                return 0
            if out:
                target[: len(out)] = out
                return len(out)
            if not part and not self.member.eof:
                return 0


def _opened(content: bytes):
    return io.BufferedReader(_Gunzip(content), 1 << 16) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _read(stream, n: int) -> tuple[bytes, bool]:
    """n bytes of a stream, and whether it ends before."""
    held = io.BytesIO()
    while (left := n - held.tell()) > 0 and (part := stream.read(min(left, 1 << 20))):
        held.write(part)
    return held.getvalue(), held.tell() < n


def _batches(rows, names: list[str], schema: pa.Schema, sized: int):
    """Arrow batches of about BATCH_BYTES each by the length of the value at `sized`."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[sized] or b"") + 256
        if n >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for c, k in zip(zip(*held, strict=True), names, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for c, k in zip(zip(*held, strict=True), names, strict=True)], schema=schema)


_ARROW = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _mapped(df: DataFrame, each, ddl: str, sized: int) -> DataFrame:
    """df through each(rows as dicts), in batches of bounded size."""
    schema = _schema(ddl)

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield dict(zip(batch.schema.names, (c[i].as_py() for c in batch.columns), strict=True))

    return df.mapInArrow(lambda batches: _batches(each(rows(batches)), schema.names, schema, sized), ddl)


# --- ARC -----------------------------------------------------------------------------------------


def write_arc(rows: DataFrame, folder: str, origin: str = "wayloom") -> None:
    """Writes (url, ip, date, mime, block) rows as ARC files; partitions with an even number in version 1, the others in 2.

    date: 14 digits (null: DATE); block: the bytes of a document with its http header, if it has one.
    """
    rows = rows.select("url", "ip", "date", "mime", "block", F.spark_partition_id().alias("part"))

    def each(rows):
        at = 0
        for row in rows:
            version, name = row["part"] % 2 + 1, f"part-{row['part']:05d}.arc"
            if not at:
                about = f"{version} 0 {origin}\n{DEFINITION[version]}\n"
                more = "" if version == 1 else "200 - - 0 " + name + " "
                first = f"filedesc://{name} 0.0.0.0 {DATE} text/plain {more}{len(about)}\n{about}".encode()
                at = len(first) + 1
                yield (first,)
            block = row["block"] or b""
            fields = [quote(row["url"] or "about:blank", safe="!#$%&'()*+,/:;=?@[]~"), row["ip"] or "0.0.0.0", row["date"] or DATE, row["mime"] or "no-type"]
            if version == 2:
                status = block[9:12].decode("ascii", "replace") if block.startswith(b"HTTP/") else "-"
                fields += [status, hashlib.md5(block).hexdigest(), "-", str(at), name]
            record = f"{' '.join(fields)} {len(block)}\n".encode() + block
            at += len(record) + 1
            yield (record,)

    _written(_mapped(rows, each, "record binary", 0), folder, "\n")


def arc_documents(content: bytes):
    """(offset, version, header fields, block, truncated) of each document of an ARC file; the version block first.

    The fields of a header line that can't be read are {"line": it}, and the last.
    """
    stream, at, version, n = _opened(content), 0, 1, 0
    while True:
        line = stream.readline()
        if not line:
            return
        start, at = at, at + len(line)
        if not (text := line.decode("utf-8", "replace").strip("\r\n")):
            continue  # the empty line between two documents
        parts = text.split(" ")
        names = ARC_FIELDS[version] if n else next((f for f in ARC_FIELDS.values() if len(f) == len(parts)), ARC_FIELDS[1])
        if len(parts) < len(names) or not parts[-1].isdigit():
            yield start, version, {"line": text}, b"", True
            return
        # only the url can hold blanks, in files of careless writers
        tail = parts[len(parts) - len(names) + 1 :]
        fields = dict(zip(names, [" ".join(parts[: len(parts) - len(names) + 1]), *tail], strict=True))
        block, broken = _read(stream, int(fields["length"]))
        at += len(block)
        if not n and fields["url"].startswith("filedesc:"):
            version = 2 if block[:1] == b"2" else 1
        n += 1
        yield start, version, fields, block, broken
        if broken:
            return


def iso_date(date: str | None) -> str:
    """An ISO timestamp of the leading digits of an ARC date, which may lack time or day."""
    digits = re.match("[0-9]*", date or "")[0][:14]
    full = digits + DATE[len(digits) :] if len(digits) >= 4 else DATE
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """The header of an http response, up to the empty line, and its payload."""
    found = re.search(rb"\r?\n\r?\n", block)
    return (block[: found.end()], block[found.end() :]) if found else (block, b"")


def convert(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The documents of all ARC files in a folder as records of WARC (RECORD)."""

    def each(files):
        for file in files:
            name = file["path"].rsplit("/", 1)[-1]
            for offset, _, fields, block, truncated in arc_documents(file["content"]):
                id_ = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>"
                url, mime = fields.get("url"), fields.get("mime")
                kind = "warcinfo" if (url or "").startswith("filedesc:") else "response" if block.startswith(b"HTTP/") else "resource"
                head, payload = http_parts(block) if kind == "response" else (b"", block)
                status = fields.get("status") or (block[9:12].decode("ascii", "replace") if kind == "response" else None)
                yield (id_, kind, url, fields.get("ip"), iso_date(fields.get("date")), "application/http; msgtype=response" if kind == "response" else mime, status,
                       head, payload if with_payload else None, len(payload), base32_sha1(payload), base32_sha1(block), hashlib.sha256(payload).digest(), truncated)

    return _mapped(_files(spark, folder), each, RECORD, RECORD_NAMES.index("payload"))


# --- revisits ------------------------------------------------------------------------------------


def mark_revisits(records: DataFrame, light: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """records with refers_to: the record id of the response with the same payload; null for the response itself.

    light: checkpointed (record_id, type, rank, payload_key, payload_bytes) of the same records, all that is compared.
    """
    able = light.where((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes))
    groups = able.groupBy("payload_key", "payload_bytes").agg(F.max(F.struct("rank", "record_id")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    groups = common.checkpoint(groups.select("payload_key", F.col("kept.record_id").alias("first")))
    key = F.when(F.col("type") == "response", F.col("payload_key"))
    joined = common.spread_join(records.withColumn("payload_key", key), groups, "payload_key", F.xxhash64("record_id"), [])
    again = F.col("first").isNotNull() & (F.col("first") != F.col("record_id")) & (F.col("payload_bytes") >= least_bytes)
    return joined.withColumn("type", F.when(again, "revisit").otherwise(F.col("type"))).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


# --- WARC ----------------------------------------------------------------------------------------


def write_warc(records: DataFrame, folder: str, software: str = "wayloom") -> None:
    """Writes records (RECORD and refers_to) as WARC files, one per partition, each with a warcinfo record first."""
    rows = records.select("record_id", "type", "url", "ip", "date", "mime", "head", "payload", "payload_digest", "block_digest", "truncated", "refers_to", F.spark_partition_id().alias("part"))

    def record(fields: list[tuple[str, str | None]], block: bytes) -> tuple[bytes]:
        lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
        return ("\r\n".join(lines).encode() + b"\r\n\r\n" + block,)

    def each(rows):
        n = 0
        for row in rows:
            if not n:
                id_ = uuid.uuid5(uuid.NAMESPACE_URL, f"info:{row['record_id']}")
                yield record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{id_}>"), ("WARC-Date", row["date"]), ("Content-Type", "application/warc-fields")], f"software: {software}\r\nformat: {WARC_VERSION}\r\n".encode())
            n += 1
            again, info = row["type"] == "revisit", row["type"] == "warcinfo"
            block = row["head"] if again else (row["head"] or b"") + (row["payload"] or b"")
            yield record(
                [
                    ("WARC-Type", row["type"]),
                    ("WARC-Record-ID", row["record_id"]),
                    ("WARC-Date", row["date"]),
                    ("WARC-Target-URI", None if info else row["url"]),
                    ("WARC-IP-Address", None if info else row["ip"]),
                    ("WARC-Payload-Digest", None if info else f"sha1:{row['payload_digest']}"),
                    ("WARC-Block-Digest", f"sha1:{base32_sha1(block) if again else row['block_digest']}"),
                    ("WARC-Refers-To", row["refers_to"]),
                    ("WARC-Profile", REVISIT if again else None),
                    ("WARC-Truncated", "unspecified" if row["truncated"] else None),
                    ("Content-Type", row["mime"]),
                ],
                block,
            )

    _written(_mapped(rows, each, "record binary", 0), folder, "\r\n\r\n")


def warc_records(content: bytes):
    """(header fields by lower-case name, block, truncated) of each record of a WARC file."""
    stream = _opened(content)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue  # the two empty lines behind a record
        fields: dict[str, str] = {"version": line.decode("utf-8", "replace").strip()}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        if not fields["version"].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            return
        block, broken = _read(stream, int(fields["content-length"]))
        yield fields, block, broken or "warc-truncated" in fields
        if broken:
            return


READ = "record_id string, type string, url string, ip string, date string, mime string, head binary, payload binary, payload_bytes long, payload_digest string, refers_to string, intact boolean, truncated boolean"


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all WARC files in a folder. A revisit has the digest that its header declares, and no payload;
    others have the digest of what was read, `intact` if it is the declared one."""

    def each(files):
        for file in files:
            for fields, block, truncated in warc_records(file["content"]):
                kind, declared = fields.get("warc-type"), (fields.get("warc-payload-digest") or "").removeprefix("sha1:")
                head, payload = http_parts(block) if "application/http" in fields.get("content-type", "") else (b"", block)
                again = kind == "revisit"
                digest = declared if again else base32_sha1(payload)
                yield (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-ip-address"), fields.get("warc-date"), fields.get("content-type"),
                       head, payload if with_payload and not again else None, None if again else len(payload), digest, fields.get("warc-refers-to"), not declared or digest == declared, truncated)

    return _mapped(_files(spark, folder), each, READ, 7)


# --- pages ---------------------------------------------------------------------------------------

ID_FIELD = "X-Page-Id"  # the http header field that carries a page's id through the archives


def page_id(head: str = "head"):
    found = F.regexp_extract(F.decode(head, "UTF-8"), rf"(?i)\r\n{ID_FIELD}: (-?[0-9]+)\r\n", 1)
    return F.when(found != "", found.cast("long"))


def page_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, ip, date, mime, block) of pages, each as an http response."""
    none = F.lit(None).cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.coalesce(F.concat(F.lit(f"{ID_FIELD}: "), F.col(id_col).cast("long").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("\r\n"))
    return pages.select(F.col(url_col).alias("url"), none.alias("ip"), none.alias("date"), F.lit("text/html").alias("mime"), F.concat(head, F.coalesce(F.col(html_col), F.lit(""))).cast("binary").alias("block"))


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Writes pages as ARC files under folder/arc and converts these to WARC files under folder/warc."""
    spark = pages.sparkSession
    write_arc(page_blocks(pages, id_col, url_col, html_col), f"{folder}/arc")
    light = convert(spark, f"{folder}/arc", with_payload=False)
    light = common.checkpoint(light.select("record_id", "type", page_id().alias("rank"), "payload_key", "payload_bytes"))
    records = mark_revisits(convert(spark, f"{folder}/arc").where("type <> 'warcinfo'"), light, least_bytes)
    write_warc(records, f"{folder}/warc")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages in the WARC files under folder/warc;
    refers_to is the id of the page that a revisit revisits, and has its size."""
    records = read_warc(spark, f"{folder}/warc", with_payload=False).where("type IN ('response', 'revisit')")
    records = common.checkpoint(records.select("record_id", page_id().alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").alias("first")))
    wanted = records.where("first IS NOT NULL").select(F.col("first").alias("record_id")).distinct()
    firsts = common.checkpoint(records.join(wanted, "record_id", "left_semi").select(F.col("record_id").alias("first"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size")))
    found = common.spread_join(records, firsts, "first", F.xxhash64("record_id"), ["first"])
    return found.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
