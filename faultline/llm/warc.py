"""WARC archives: a writer with one gzip member a record and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES, READ_BYTES = 16 << 20, 1 << 20
FIXED_DATE = "2000-01-01T00:00:00Z"
SCHEMA = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"


def file_system(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record_id(page_id) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(url) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", "%20", url or "")


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit of the response to page refers_to, whose block keeps the HTTP header only."""
    page = "" if page_id is None else int(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {FIXED_DATE}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Page-Id: {page}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {int(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def plan_records(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: of equal payloads of at least min_payload bytes the smallest page_id answers, the
    others revisit it. Payload groups are reduced to a minimum before they meet their pages again; pages are shuffled by digest for that
    unless the groups are few enough for Spark to broadcast them, and a payload of very many pages is split by Spark's skew join.
    Rows of one page_id and payload are one page and alike; without any page_id in a group all of it are responses.
    """
    text = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.withColumn("fl_digest", F.sha1(text)).withColumn("fl_bytes", F.length(text))
    groups = rows.where(F.col("fl_bytes") >= min_payload).groupBy("fl_digest").agg(F.min("page_id").alias("fl_first"), F.count("*").alias("fl_n"))
    again = groups.where("fl_n > 1 AND fl_first IS NOT NULL").select("fl_digest", "fl_first")
    joined = rows.join(again, "fl_digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("fl_first")), F.col("fl_first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Writes an archive for each partition of pages (page_id, url, html) and returns (path, bytes), one row a file.

    Files get their names when they are whole, by partition and attempt, and only the attempt that Spark reports counts.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get()
        system, root = file_system(folder)
        path = f"{root}/part-{at.partitionId():05d}-{at.taskAttemptId()}.warc.gz"
        size, out = 0, None
        for f in frames:
            for page, url, html, first in zip(f["page_id"], f["url"], f["html"], f["refers_to"]):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                data = record(None if pd.isna(page) else page, url, (html or "").encode("utf-8", "surrogatepass"), None if pd.isna(first) else first)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size]})

    return plan_records(pages, min_payload).mapInPandas(each, "path string, bytes long")


class Window:
    """Random access to a file through a buffer of a bounded size."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, READ_BYTES))
        return self.data[at - self.at : at - self.at + n]


def member(window: Window, at: int) -> Iterator[bytes]:
    """Parts of the gzip member at a place; ValueError if there is none. The last item is its length in the file."""
    d, pos = zlib.decompressobj(31), at
    while not d.eof:
        part = window.read(pos, 1 << 16)
        if not part:
            raise ValueError("it ends within a member")
        try:
            out = d.decompress(part)
        except zlib.error as e:
            raise ValueError("no gzip member") from e
        pos += len(part) - len(d.unused_data)
        if out:
            yield out
    yield pos - at


def headers(block: bytes) -> dict[str, str] | None:
    head, found, _ = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def starts_record(window: Window, at: int) -> bool:
    """Whether a gzip member that begins with a WARC version line is at a place."""
    try:
        got = b""
        for part in member(window, at):
            if isinstance(part, int):
                break
            got += part
            if len(got) >= 7:
                break
        return got.startswith(b"WARC/1.")
    except ValueError:
        return False


def records(path_fs, path: str, start: int, end: int, size: int) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """(headers, block) of the records that start in the bytes [start, end) of a file; (None, b"") for one that is damaged.

    The range is scanned for gzip magic; a candidate counts if it inflates to a WARC header, so that bytes that look
    like magic inside a member are passed over. From then on members follow each other. Behind a member that breaks off or
    has no whole header, the scan for magic goes on.
    """
    with path_fs.open_input_file(path) as f:
        window, at = Window(f, size), start
        while at < end:
            part = window.read(at, min(READ_BYTES, size - at))
            k = part.find(MAGIC)
            if k < 0:
                at += max(1, len(part) - 2)
                if at + 3 > size:
                    return
                continue
            at += k
            if at >= end:
                return
            if not starts_record(window, at):
                at += 1
                continue
            whole, n = [], 0
            try:
                for x in member(window, at):
                    if isinstance(x, int):
                        n = x
                    else:
                        whole.append(x)
            except ValueError:
                yield None, b""
                at += 1
                continue
            raw = b"".join(whole)
            head = headers(raw)
            if head is None:
                yield None, b""
            else:
                body, length = raw[raw.index(b"\r\n\r\n") + 4 :], head.get("content-length", "")
                short = length.isdecimal() and len(body) < int(length)
                yield (None, b"") if short else (head, body[: int(length)] if length.isdecimal() else body)
            at += n


def parsed(head: dict[str, str] | None, block: bytes) -> tuple:
    """(status, page_id, url, payload_digest, payload_bytes, record_type, refers_to, payload) of a record: ok for a whole response,
    revisit or resource, foreign for other types, damaged where it breaks off or its payload isn't the one its header names.
    """
    if head is None:
        return ("damaged", *(None,) * 7)
    kind, number = head.get("warc-type", ""), lambda x: int(x) if re.fullmatch(r"-?\d+", x or "") else None
    fields = (number(head.get("x-page-id")), head.get("warc-target-uri"))
    if kind not in ("response", "revisit", "resource"):
        return ("foreign", *fields, None, None, kind, None, None)
    http, found, payload = block.partition(b"\r\n\r\n") if kind != "resource" else (b"", b"x", block)
    named = head.get("warc-payload-digest", "")
    named = named[5:].upper() if named[:5].lower() == "sha1:" else None
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    if kind == "revisit":
        n = int(length[1]) if length else None
    else:
        n, own = len(payload), digest(payload)
        if not found or named not in (None, own) or length and int(length[1]) != n:
            return ("damaged", *fields, named, None, kind, None, None)
        named = own
    return ("ok", *fields, named, n, kind, number(head.get("x-refers-to-page-id")), payload if kind != "revisit" else b"")


def splits(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, bytes, start, end): byte ranges of files (path, bytes)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("bytes") - 1), F.lit(split_bytes).cast("long"))
    cut = files.select("path", "bytes", F.explode(starts).alias("start"))
    return cut.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes"))).repartition(partitions(spark), "path", "start")


def scan(spark: SparkSession, files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """status, page_id, url, payload_digest, payload_bytes, record_type, refers_to (and payload) of all records of files
    (path, bytes), as parsed() gives them; no record stops the job.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = file_system(folder)
        for f in frames:
            for path, size, start, end in zip(f["path"], f["bytes"], f["start"], f["end"]):
                out, held = [], 0
                for head, block in records(system, path, int(start), int(end), int(size)):
                    row = parsed(head, block)
                    out.append(row if with_payload else row[:-1])
                    held += len(block) if with_payload else 100
                    if held > 8 << 20:
                        yield frame(out)
                        out, held = [], 0
                if out:
                    yield frame(out)

    def frame(rows: list) -> pd.DataFrame:
        names = ["status", *[x.split()[0] for x in SCHEMA.split(", ")], *["payload"] * with_payload]
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    return splits(spark, files, split_bytes).mapInPandas(each, "status string, " + SCHEMA + ", payload binary" * with_payload)


def read(spark: SparkSession, files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_digest, payload_bytes, record_type, refers_to (and payload) of the whole responses, revisits and resources
    of files. The digest of a payload is computed and must equal the header's; that of a revisit, and its payload's size,
    are those its header names. Records of other types and damaged ones are left out; skipped() counts them.
    """
    return scan(spark, files, folder, split_bytes, with_payload).where("status = 'ok'").drop("status")


def skipped(spark: SparkSession, files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """status, record_type, n: how many records read() leaves out."""
    return scan(spark, files, folder, split_bytes).where("status <> 'ok'").groupBy("status", "record_type").agg(F.count("*").alias("n"))


def round_trip(pages: DataFrame, scratch: Scratch, min_payload: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads the records back.

    Null html is empty; a null url is empty; a null page_id stays null. Of equal payloads the smallest page_id answers, all its
    repeated rows alike, and the others revisit it; payloads of any length are written whole; other columns are not read. No rows:
    no files, no records.
    """
    spark, folder = pages.sparkSession, scratch.root + "/warc"
    files = scratch.keep(write(pages.select("page_id", "url", "html"), folder, min_payload))
    return read(spark, files, folder)
