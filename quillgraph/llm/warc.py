"""WARC archives in Zstandard: one frame per record, with a dictionary of their own.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds its dictionary,
plain or itself a Zstandard frame; then each WARC/1.1 record is one frame compressed with
it. The reader loads the dictionary, walks the frames one at a time by their lengths (a
frame is decoded only when its turn comes, and only up to MAX_RECORD bytes), and validates
the frame, the version line, the headers it needs, Content-Length against what is there,
and the record's end; a fault raises ValueError with the archive's name and offset, or
yields a row with its error where ``strict`` is off.

Records with equal payloads of at least ``min_revisit`` bytes (equal SHA-1 and length):
the one with the smallest page_id is the response, the others are revisits without payload
that refer to it. Payloads go through one shuffle, by digest, so a payload that a third of
all pages share is one aggregate and a join that Spark may split.

Null html counts as empty, a null url as an empty target; line breaks and other control
characters of a url are percent-encoded. Rows that share the smallest page_id are all
responses; a null page_id stays null and counts as the largest. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, small_batches

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: An archive is closed once its records hold this many bytes.
ARCHIVE_BYTES = 16_000_000
#: The dictionary's size, and the bytes of an archive's first records it is trained on.
DICT_BYTES, SAMPLE_BYTES, SAMPLE_RECORD = 32_768, 2_000_000, 16_384
#: No column holds 2 GiB, so no record that was written is longer than that and its headers.
MAX_RECORD = (1 << 31) + (1 << 20)
#: Bytes given to the decoder at a time.
FEED = 1 << 14
#: All records bear this date: archives of the same rows are the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile("[\x00-\x20\x7f]")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page/{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC record: a response, or a revisit where ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on the archive's own first records; empty where they are too few."""
    sample, size = [], 0
    for r in records:
        sample.append(r[:SAMPLE_RECORD])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    if len(sample) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, size // 8), sample, k=256, d=8, steps=4).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes]) -> bytes:
    d = _dictionary(records)
    held = zstandard.ZstdCompressor(level=9).compress(d) if d else b""
    z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(held)), held, *[z.compress(r) for r in records]])


def read_archive(data: bytes, name: str = "archive"):
    """(offset, headers, block) of each record; ValueError at the first fault."""
    at, decoder = 0, None

    def fault(what):
        return ValueError(f"{name} at {at}: {what}")

    if len(data) < 8:
        raise fault("no leading frame")
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise fault("no dictionary frame")
    if 8 + n > len(data):
        raise fault("the dictionary frame is cut short")
    held = data[8 : 8 + n]
    try:
        if held[:4] == struct.pack("<I", FRAME):
            held = zstandard.ZstdDecompressor().decompress(held, max_output_size=MAX_RECORD)
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
    except zstandard.ZstdError as e:
        raise fault(f"bad dictionary ({e})") from e
    at = 8 + n
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 4 <= len(data) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50 and at + 8 <= len(data):  # a skippable frame between records
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME:
            raise fault("no frame")
        one = decoder.decompressobj(read_across_frames=False)
        out, size, fed = [], 0, at
        while not one.eof:
            if fed >= len(data):
                raise fault("the last frame is cut short")
            try:
                out.append(one.decompress(data[fed : fed + FEED]))
            except zstandard.ZstdError as e:
                raise fault(f"bad frame ({e})") from e
            fed = min(len(data), fed + FEED)
            size += len(out[-1])
            if size > MAX_RECORD:
                raise fault("a record is too long")
        yield at, *_parse(b"".join(out), fault)
        at = fed - len(one.unused_data)


def _parse(raw: bytes, fault):
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise fault("headers do not end")
    lines = raw[:end].decode("utf-8", "surrogateescape").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise fault("no WARC version line")
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise fault("a header without a name")
        headers[key.strip().lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in headers:
            raise fault(f"no {key}")
    if not headers["content-length"].isdigit():
        raise fault("content-length is no number")
    n = int(headers["content-length"])
    block = raw[end + 4 : end + 4 + n]
    if len(block) != n or raw[end + 4 + n :] != b"\r\n\r\n":
        raise fault("content-length and the record's length differ")
    return headers, block


def _row(headers: dict, block: bytes, fault):
    """page_id, bytes and digest of the full payload, type, reference, url, payload."""
    cut = block.find(b"\r\n\r\n")
    if cut < 0:
        raise fault("no HTTP headers")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[:cut])
    payload, kind = block[cut + 4 :], headers["warc-type"]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if length and int(length[1]) != len(payload):
            raise fault("the HTTP length and the payload's differ")
        if digest != sha1_base32(payload):
            raise fault("the payload's digest differs")
        size = len(payload)
    else:
        if not length:
            raise fault("a revisit without its payload's length")
        size = int(length[1])
    number = lambda key: int(headers[key]) if headers.get(key) else None
    return number("x-page-id"), size, digest, kind, number("x-refers-to-page-id"), headers.get("warc-target-uri"), payload if kind == "response" else None


def _write_task(batches):
    """(archive, content): a task's rows as archives of about ARCHIVE_BYTES."""
    task, made, records, size = TaskContext.get().partitionId(), 0, [], 0

    def close():
        return pa.RecordBatch.from_arrays(
            [pa.array([f"part-{task:06d}-{made:05d}.warc.zst"]), pa.array([write_archive(records)], pa.binary())], ["archive", "content"]
        )

    for b in batches:
        for page, url, html, first in zip(*(b.column(i).to_pylist() for i in range(4))):
            records.append(record(page, url, (html or "").encode("utf-8", "surrogatepass"), first))
            size += len(records[-1])
            if size >= ARCHIVE_BYTES:
                yield close()
                made, records, size = made + 1, [], 0
    if records:
        yield close()


def archives(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(archive, content): the archives of all pages."""
    small_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    first = p.filter(F.col("size") >= min_revisit).groupBy("digest", "size").agg(F.min("page_id").alias("first"))
    rows = p.join(first, ["digest", "size"], "left")
    refers = F.when((F.col("first") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.col("first"))
    return rows.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_write_task, "archive string, content binary")


_READ = "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, error string"


def read(files: DataFrame, name_col: str = "archive", payloads: bool = True, strict: bool = True) -> DataFrame:
    """Records of archives: a frame of (name, content), such as what ``archives`` gives or
    ``spark.read.format("binaryFile")`` (with ``name_col="path"``) over .warc.zst files."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in _READ.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, held = [], 0
                try:
                    for at, headers, block in read_archive(content or b"", name or "archive"):
                        page, size, digest, kind, ref, url, payload = _row(headers, block, lambda what, at=at: ValueError(f"{name} at {at}: {what}"))
                        rows.append((name, at, page, size, digest, kind, ref, url, payload if payloads else None, None))
                        held += len(block) if payloads else 64
                        if held >= 8_000_000:
                            yield batch(rows)
                            rows, held = [], 0
                except ValueError as e:
                    if strict:
                        raise
                    rows.append((name, None, None, None, None, None, None, None, None, str(e)))
                if rows:
                    yield batch(rows)

    small_batches(files.sparkSession)
    return files.select(F.col(name_col).alias("archive"), "content").mapInArrow(run, _READ)


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    s = Scratch(pages.sparkSession, "warc")
    written = s.write(archives(pages, min_revisit), "archives")
    got = s.write(read(written, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    s.drop(written)
    return s.keep(got)
