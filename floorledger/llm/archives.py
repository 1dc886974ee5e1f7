"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: each task writes archives of its own under new names and reports them; the report is stored as a table, so
only archives of tasks that Spark accepted are ever read, and files of a lost task do not matter.  Reading streams an
archive frame by frame, so a task holds one record and a block of the file, whatever the archive's size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.llm.scratch import stored
from floorledger.operators.keyfilter import key_words, possible_rows
from floorledger.operators.lookup import is_broadcast
from floorledger.session import scratch_folder

# The skippable frame of a dictionary, the other skippable frames, a raw dictionary, a Zstandard frame.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
RAW_DICTIONARY = b"\x37\xa4\x30\xec"
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED_HEADERS = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

# An archive is closed at this size; a dictionary is trained on the first records of its task, up to these bytes.
ARCHIVE_BYTES = 256 * 2**20
SAMPLE_BYTES, DICTIONARY_BYTES = 2 * 2**20, 32 * 2**10
READ_BYTES = 2**20
# From this size on, equal payloads are stored once.
LEAST_REVISIT_BYTES = 0

MANIFEST = "archive string, records long, bytes long"
RECORDS = (
    "archive string, page_id long, url string, record_type string, refers_to long, payload_digest string, "
    "payload_bytes long, payload binary, problem string"
)


class ArchiveError(ValueError):
    pass


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ----------------------------------------------------------------------------------------------------


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record; a revisit carries the response's headers only, with the full payload's length."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() if revisit else http.encode() + payload
    headers = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}"]
    if url is not None:
        headers.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=''.join(map(chr, range(0x21, 0x7F))))}")
    headers += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        headers += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    headers += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(headers).encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]):
    """Trained on the samples; None where they are too few or too alike for that."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    def __init__(self, folder: str, dictionary):
        import zstandard
        from pyarrow import fs

        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        self.records = self.bytes = 0
        if dictionary:
            packed = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
            self._write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._write(self.packer.compress(data))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.records, self.bytes


def _originals(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with the smallest page_id of equal payloads.

    Only payloads that occur twice are joined: by a broadcast of their digests, or where that is too large after a filter
    of fixed size, so that payloads that occur once are not shuffled but for its few false positives.
    """
    keyed = pages.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    twice = (
        keyed.where(F.col("bytes") >= least_bytes)
        .groupBy("sha", "bytes")
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .drop("times")
    )
    twice, keys = stored(twice), ["sha", "bytes"]
    if is_broadcast(twice):
        found = keyed.join(twice, keys, "left")
    else:
        words = key_words(twice, keys)
        single = possible_rows(keyed, keys, words, other=True).withColumn("original", F.lit(None).cast("long"))
        found = possible_rows(keyed, keys, words).join(twice, keys, "left").unionByName(single)
    refers_to = F.when(F.col("original") != F.coalesce("page_id", F.col("original") - 1), F.col("original"))
    return found.select("page_id", "url", "payload", refers_to.alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, least_revisit_bytes: int = LEAST_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the manifest of archives.

    Null html is an empty payload, a null url is left out, a null page_id gives an empty name.  Of equal payloads the
    smallest page_id is the response (every row of it, if it repeats), the others revisit it.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        waiting_bytes, dictionary, writer, done = 0, None, None, []

        def add(data: bytes) -> None:
            nonlocal writer
            writer = writer or ArchiveWriter(folder, dictionary)
            writer.add(data)
            if writer.bytes >= archive_bytes:
                done.append(writer.close())
                writer = None

        def settle() -> None:
            nonlocal dictionary, waiting
            if waiting:
                dictionary = _dictionary(waiting)
                for data in waiting:
                    add(data)
                waiting = []

        settled = False
        for part in parts:
            for page_id, url, payload, refers_to in zip(*(column for column in part.columns), strict=True):
                body = payload.as_py()
                data = record(page_id.as_py(), url.as_py(), body, refers_to.as_py(), payload_digest(body))
                if settled:
                    add(data)
                    continue
                waiting.append(data)
                waiting_bytes += len(data)
                if waiting_bytes >= SAMPLE_BYTES:
                    settle()
                    settled = True
        settle()
        if writer:
            done.append(writer.close())
        names, types = ["archive", "records", "bytes"], (pa.string(), pa.int64(), pa.int64())
        columns = list(zip(*done, strict=True)) if done else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(column), kind) for column, kind in zip(columns, types, strict=True)], names
        )

    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload)
    return stored(_originals(rows, least_revisit_bytes).mapInArrow(write, MANIFEST))


# --- reading ----------------------------------------------------------------------------------------------------


def frames(stream) -> Iterator[bytes]:
    """Decoded frames of an archive, in order, with the dictionary of the leading skippable frame if there is one."""
    import zstandard

    held = stream.read(READ_BYTES)
    decoder, first = zstandard.ZstdDecompressor(), True

    def need(n: int) -> bytes:
        nonlocal held
        while len(held) < n:
            more = stream.read(max(READ_BYTES, n - len(held)))
            if not more:
                raise ArchiveError("the archive ends inside a frame")
            held += more
        return held

    while held:
        magic = struct.unpack("<I", need(4)[:4])[0]
        if magic in SKIPPABLE_FRAMES:
            size = struct.unpack("<I", need(8)[4:8])[0]
            body, held = need(8 + size)[8 : 8 + size], held[8 + size :]
            if first and magic == DICTIONARY_FRAME:
                raw = body if body.startswith(RAW_DICTIONARY) else zstandard.ZstdDecompressor().decompress(body)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        else:
            frame, pieces = decoder.decompressobj(), []
            try:
                while not frame.eof:
                    if not held:
                        held = need(1)
                    pieces.append(frame.decompress(held))
                    held = frame.unused_data if frame.eof else b""
            except zstandard.ZstdError as error:
                raise ArchiveError(f"bad frame: {error}") from error
            yield b"".join(pieces)
        first = False
        held = held or stream.read(READ_BYTES)


def _headers(lines: list[str]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"bad header line {line[:80]!r}")
        found[name.lower()] = value.strip()
    return found


def _number(text: str | None, what: str) -> int:
    if text is None or not re.fullmatch("[0-9]+", text):
        raise ArchiveError(f"bad {what} {text!r}")
    return int(text)


def _page(name: str | None) -> int | None:
    found = re.fullmatch("<urn:page:(-?[0-9]*)>", name or "")
    if not found:
        raise ArchiveError(f"bad record name {name!r}")
    return int(found[1]) if found[1] else None


def parse_record(data: bytes) -> dict:
    """Checks version, needed headers, both lengths, the end of the record and a response's digest."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank:
        raise ArchiveError("no end of headers")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ArchiveError(f"bad version {lines[0][:40]!r}")
    headers = _headers(lines[1:])
    missing = [name for name in NEEDED_HEADERS if name.lower() not in headers]
    if missing:
        raise ArchiveError(f"no {', '.join(missing)}")
    length = _number(headers["content-length"], "Content-Length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP headers")
    full = _number(_headers(http.decode("latin-1").split("\r\n")[1:]).get("content-length"), "HTTP Content-Length")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != full:
            raise ArchiveError(f"payload of {len(payload)} bytes, HTTP Content-Length {full}")
        if payload_digest(payload) != digest:
            raise ArchiveError("the payload's digest is another")
    elif kind != "revisit":
        raise ArchiveError(f"unexpected type {kind!r}")
    return {
        "page_id": _page(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page(headers.get("warc-refers-to")) if kind == "revisit" else None,
        "payload_digest": digest,
        "payload_bytes": full,
        "payload": payload if kind == "response" else None,
    }


def read_archives(manifest: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """A row per record of the archives that ``manifest`` names in its column archive.

    A record that fails a check stops the job, or with ``strict=False`` becomes a row with only archive and problem.
    Without ``payloads`` that column is null; payloads are checked all the same.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema(
            [("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
             ("payload", pa.binary()), ("problem", pa.string())]
        )
        rows: list[dict] = []
        held = 0
        for part in parts:
            for uri in part.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(path) as stream:
                    for data in frames(stream):
                        row: dict = {"archive": uri}
                        try:
                            row |= parse_record(data)
                        except ArchiveError as error:
                            if strict:
                                raise ArchiveError(f"{uri}: {error}") from error
                            row["problem"] = str(error)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row.get("payload") or b"")
                        if len(rows) >= 1000 or held >= 4 * 2**20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    # A task per archive: by the size of their names alone Spark would put them into one.
    names = manifest.select("archive").distinct()
    return names.repartition(max(1, names.count()), "archive").mapInArrow(read, RECORDS)


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives in ``folder`` (default: a new shared one) and reads them back, without payloads."""
    return read_archives(write_archives(pages, folder or f"{scratch_folder(spark)}/archives"), payloads=False)
