"""WARC archives with Zstandard: one frame per record, the dictionary in front.

An archive begins with a skippable frame that holds the dictionary; every record is a frame of
its own, compressed with it. Spark's text writer puts the frames into files, an empty skippable
frame between them, so that files are committed as any table is. The reader walks the frames,
checks headers and lengths, and gives a row per record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepline.llm.scratch import Scratch, some_rows

# Fixed values of the format.
DICT_MAGIC = 0x184D2A5D
SKIP_MAGIC = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

GAP = struct.pack("<II", SKIP_MAGIC[0], 0)  # an empty skippable frame, the line separator of the text writer
RECORDS_PER_FILE = 2_048  # frames of an archive, the dictionary counted
SAMPLE_PAGES, DICT_BYTES = 1_000, 65_536
PLAIN = b"<html><head><title></title></head><body></body></html>"  # the dictionary where there is no payload
LEVEL = 3
MIN_REVISIT_BYTES = 0

SCHEMA = "page string, record_type string, refers_to string, url string, payload binary, payload_bytes long, payload_digest string, problem string"


def train_dictionary(pages: DataFrame, html_col: str) -> bytes:
    """A dictionary from at most SAMPLE_PAGES payloads, by hash; where too few to train on, their plain beginning."""
    rows = pages.where(F.length(html_col) > 0).select(F.col(html_col).cast("binary").alias("h"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [h for b in batches for h in b.column(0).to_pylist()]
        try:
            made = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            made = b"".join(samples)[:DICT_BYTES] or PLAIN
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["d"])

    made = some_rows(rows, SAMPLE_PAGES, "h").coalesce(1).mapInArrow(train, "d binary").first()
    return made["d"] if made else PLAIN


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header value: line breaks, which would end it, are percent-encoded."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit of the page refers_to, which keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_line(page)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url if url is not None else 'urn:unknown')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{_line(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _frames(batches: Iterator[pa.RecordBatch], raw: bytes, per_file: int) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_checksum=True, write_content_size=True)
    first = struct.pack("<II", DICT_MAGIC, len(raw)) + raw
    at = 0
    for b in batches:
        for page, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out = [first] if at % per_file == 0 else []
            out.append(packer.compress(record(page, url, payload, refers)))
            at += len(out)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row below path; of equal payloads the smallest id is the response, others revisit it.

    A null payload is empty, payloads below min_revisit_bytes are never revisits. Rows that share
    the smallest id are responses alike; a null id is larger than any, written as ``null``. No
    rows write no archive.
    """
    bare = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    keyed = bare.withColumn("sha", F.sha1("html"))
    firsts = bare.where(F.octet_length("html") >= min_revisit_bytes).groupBy(F.sha1("html").alias("sha")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    known = keyed.join(firsts.drop("n"), "sha", "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    rows = known.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("page"), "url", F.col("html").cast("binary").alias("payload"), refers.alias("refers"))
    raw = train_dictionary(pages, html_col)
    made = rows.mapInArrow(partial(_frames, raw=raw, per_file=per_file), "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", GAP.decode("ascii")).option("maxRecordsPerFile", per_file).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its header and block headers."""
    kind = data[at + 4]
    at += zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last, size = bool(head & 1), head >> 3
        at += 3 + (1 if (head >> 1) & 3 == 1 else size)
    at += 4 if kind & 4 else 0
    if at > len(data):
        raise ValueError("frame is cut off")
    return at


def parse(raw: bytes) -> tuple:
    """(page, type, refers to, url, payload, its length, its digest) of one record; ValueError if it is not whole."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon:
            raise ValueError(f"bad header line: {line[:80]}")
        fields[name.lower()] = value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("block length differs from Content-Length")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no HTTP header")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (size != len(payload) or digest != base32_sha1(payload)):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("revisit with a payload or without target")
    name = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    refers = name(fields["warc-refers-to"]) if kind == "revisit" else None
    return name(fields["warc-record-id"]), kind, refers, fields.get("warc-target-uri"), payload if kind == "response" else None, size, digest


def records(data: bytes) -> Iterator[tuple]:
    """The rows of one archive (SCHEMA); a damaged record is a row that names the problem, a damaged frame ends the archive."""
    view, at, unpack = memoryview(data), 0, None
    try:
        while at < len(view):
            magic, size = struct.unpack_from("<II", view, at)
            if magic == DICT_MAGIC and unpack is None:
                unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(view[at + 8 : at + 8 + size])))
            if magic in SKIP_MAGIC:
                at += 8 + size
                if at > len(view):
                    raise ValueError("skippable frame is cut off")
                continue
            if magic != FRAME_MAGIC or unpack is None:
                raise ValueError("no frame" if unpack else "no dictionary in front")
            end = frame_end(view, at)
            try:
                yield (*parse(unpack.decompress(bytes(view[at:end]))), None)
            except (ValueError, UnicodeDecodeError, zstandard.ZstdError) as e:
                yield (None,) * 7 + (str(e),)
            at = end
    except (ValueError, struct.error, zstandard.ZstdError) as e:
        yield (None,) * 7 + (f"at byte {at}: {e}",)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for b in batches:
        for data in b.column(0):
            rows: list[tuple] = []
            for r in records(data.as_py()):
                rows.append(r)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives below path (SCHEMA); problem is null for a whole one."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    return files.mapInArrow(_read, SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """pages written as archives in the shared folder and read back."""
    path = f"{Scratch(pages.sparkSession, 'warc').root}/archives"
    write_archives(pages, path, id_col, **options)
    return read_archives(pages.sparkSession, path)
