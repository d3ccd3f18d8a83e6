"""WARC archives: writing one gzip member a record, and a splittable reader.

A reading task owns a byte range. It looks for gzip magic, decodes the header of each candidate member to see
whether it is a WARC record, and yields the records that start inside its range, reading on past the end to finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES, BLOCK = 16_000_000, 1 << 20
DATE = "2024-01-01T00:00:00Z"  # constant, so that archives are reproducible


def _filesystem(path: str):
    """Any store that pyarrow knows: file, hdfs, s3, gs; a bare path is a shared mount."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def _record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, origin: int | None) -> bytes:
    name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{k}')}>"
    body = b"" if kind == "revisit" else payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": name(page),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(body)),
    }
    if page is not None:
        head["X-Page-ID"] = str(page)
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(origin), "X-Refers-To-Page": str(origin), "X-Payload-Length": str(len(payload))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + body + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write pages(page_id, url, html) as archives in folder; the manifest (path, n_bytes, n_records).

    Payload: html in UTF-8, null as empty. Of pages with equal payloads of at least
    least_bytes the one with the largest page_id is the response, the others revisit it.
    Null page_ids are smaller than all others; where all ids of a payload are null,
    or several rows have the largest, each of these is a response. Payloads and urls of any length are written whole, a null url as urn:none; an empty table
    gives no file; other columns are ignored. A retried task writes a new file; only files of the manifest count.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("sha1", F.sha1("payload"))
    # a payload that very many pages share is aggregated before the shuffle; the pages then meet the responses by digest, payloads and all, and adaptive execution divides a common one
    latest = pages.where(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = pages.join(latest, "sha1", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page, url, payload, sha1, origin in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "sha1", "origin"))):
                if out is None:
                    fs, at = _filesystem(folder)
                    fs.create_dir(at, recursive=True)
                    fs, at = _filesystem(path)
                    out = fs.open_output_stream(at, compression=None)
                kind = "response" if origin is None or page == origin else "revisit"
                data = _record(kind, page, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), origin)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], ["path", "n_bytes", "n_records"])

    return marked.select("page_id", "url", "payload", "sha1", "origin").mapInArrow(write, "path string, n_bytes long, n_records long")


def list_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, n_bytes) of archives that Spark lists; their content isn't read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("n_bytes"))


class _Window:
    """Forward reads from a file; keeps what hasn't been passed, in blocks."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data, self.over = file, at, b"", False
        file.seek(at)

    def more(self) -> bool:
        block = self.file.read(BLOCK)
        self.data += block
        self.over = not block
        return bool(block)

    def drop(self, at: int) -> None:
        """Forget what lies before the offset."""
        self.data = self.data[at - self.base :]
        self.base = at


def _member(w: _Window, at: int) -> tuple[dict[str, str], bytes | None, int] | None:
    """The record of the gzip member at an offset: headers, payload, offset behind it; None if there is no WARC record.

    The payload is None where the member breaks off, is damaged or is shorter than its header says.
    """
    z, text, pos = zlib.decompressobj(31), bytearray(), at
    head, looked, whole = -1, 0, True
    while whole and not z.eof:
        if pos >= w.base + len(w.data) and not w.more():
            whole = False
            break
        chunk = w.data[pos - w.base : pos - w.base + (4096 if head < 0 else BLOCK)]
        try:
            text += z.decompress(chunk)
        except zlib.error:
            whole = False
        pos += len(chunk)
        if head < 0:
            if not (text.startswith(b"WARC/1.") or b"WARC/1.".startswith(bytes(text[:7]))):
                return None
            # a header may be of any length; what came before is searched once
            head = text.find(b"\r\n\r\n", max(0, looked - 3))
            looked = len(text)
    if head < 0:
        return None
    fields = dict(line.split(": ", 1) for line in text[:head].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    length = fields.get("Content-Length", "")
    if "WARC-Type" not in fields:
        return None
    if not whole or not length.isdigit() or len(text) < head + 4 + int(length):
        return fields, None, at + 1
    return fields, bytes(text[head + 4 : head + 4 + int(length)]), pos - len(z.unused_data)


def records_in(file, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, compressed size, headers, payload) of the records of an archive that start in [start, end); payload None for damaged ones, after which the search goes on."""
    w, at = _Window(file, start), start
    while at < end:
        hit = w.data.find(MAGIC, at - w.base)
        if hit < 0:
            if w.over:
                return
            at = max(at, w.base + len(w.data) - 2)
            w.drop(at)
            w.more()
            continue
        at = w.base + hit
        if at >= end:
            return
        w.drop(at)
        if found := _member(w, at):
            fields, payload, behind = found
            yield at, behind - at, fields, payload
            at = behind
        else:
            at += 1


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of archives(path, n_bytes): path, offset, size, warc_type, headers, payload, digest_ok.

    digest_ok: the payload's SHA-1 is the header's (null where there is none or the
    record is a revisit). Bytes that are no WARC member are skipped, empty archives and tables give nothing. A record with a header whose
    body breaks off or is damaged has a null payload and is not digest_ok. Headers and payloads may be of any length; an archive listed twice is read twice. Other columns are ignored.
    """
    ranges = archives.select("path", "n_bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("n_bytes")).alias("end"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "size", "warc_type", "headers", "payload", "digest_ok"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path, start, end in zip(*(batch[c].to_pylist() for c in ("path", "start", "end"))):
                fs, at = _filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(at) as file:
                    for offset, size, fields, payload in records_in(file, start, end):
                        kind, digest = fields["WARC-Type"], fields.get("WARC-Payload-Digest")
                        ok = False if payload is None else None if kind == "revisit" or not digest else digest == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        rows.append((path, offset, size, kind, list(fields.items()), payload, ok))
                        held += len(payload or b"") + 500
                        if held > 4_000_000:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    parts = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(parts, "path", "start").mapInArrow(read, "path string, offset long, size long, warc_type string, headers map<string,string>, payload binary, digest_ok boolean")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = written(write_warc(table(spark, sf_dir, "pages"), scratch(spark, "warc")), "manifest")
    h = F.col("headers")
    digest = F.substring(h["WARC-Payload-Digest"], 6, 32)
    return read_warc(manifest).select(
        h["X-Page-ID"].cast("long").alias("page_id"), F.coalesce(h["X-Payload-Length"].cast("long"), F.length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.coalesce("digest_ok", F.lit(True)), digest).alias("payload_digest"), F.col("warc_type").alias("record_type"), h["X-Refers-To-Page"].cast("long").alias("refers_to"),
    )
