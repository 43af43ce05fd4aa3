"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Writer tasks write files under names of their own and return a manifest row for each. The
manifest is what counts: files of a lost or repeated task are in no manifest.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.workspace import Scratch

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

MAX_FILE_BYTES = 256 << 20
#: A file's dictionary is trained on its first records, up to so many bytes.
TRAINING_BYTES, DICTIONARY_BYTES = 2 << 20, 32 << 10
READ_BYTES = 1 << 20
_NAMESPACE = uuid.UUID(int=0x77617263)


def digest_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def with_record_types(pages: DataFrame, scratch: Scratch, min_payload: int = 0) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to) of pages (page_id, url, html).

    Of the records with equal payloads of at least ``min_payload`` bytes, that with the largest page_id
    is the response and the others revisit it. A null html is an empty payload; a null page_id is the least. Rows
    that repeat the response's page_id and payload are responses too.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    read = pages.select("page_id", "url", payload.alias("payload"))
    keyed = read.withColumn("key", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    repeated = scratch.keep(
        keyed.where(F.col("bytes") >= min_payload)
        .groupBy("key", "bytes")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "repeated",
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.join(repeated, ["key", "bytes"], "left").select(
        "page_id",
        "url",
        "payload",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_bytes(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    digest = digest_text(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_text(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few records to learn from
        return None


def _file(root: str, records: Iterator[bytes], max_bytes: int) -> tuple[str, int, int, Iterator[bytes]]:
    """Write one archive; returns its name, its number of records and bytes, and the records for the next one."""
    held, size = [], 0
    while size < TRAINING_BYTES and (record := next(records, None)) is not None:
        held.append(record)
        size += len(record)
    trained = _trained(held)
    squeeze = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True).compress
    name, (store, folder) = f"{uuid.uuid4().hex}.warc.zst", fs.FileSystem.from_uri(root)
    stream, count, written = _chain(held, records), 0, 0
    with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
        if trained is not None:
            content = trained.as_bytes()
            written += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        for record in stream:
            written += out.write(squeeze(record))
            count += 1
            if written >= max_bytes:
                break
    return name, count, written, stream


def _chain(held: list[bytes], rest: Iterator[bytes]) -> Iterator[bytes]:
    """All of ``held``, each let go once it is out, then the rest."""
    held.reverse()
    while held:
        yield held.pop()
    yield from rest


def write_archives(
    records: DataFrame, root: str, scratch: Scratch, date: str = "2024-01-01T00:00:00Z", max_bytes: int = MAX_FILE_BYTES
) -> DataFrame:
    """Write ``records`` (as of ``with_record_types``) below ``root``; returns the manifest (path, records, bytes).

    A task begins a new file once one has ``max_bytes``. A task without rows writes none.
    """

    def write(batches):
        def encoded():
            for batch in batches:
                for row in range(len(batch)):
                    page_id, url, payload, kind, refers_to = (c[row].as_py() for c in batch.columns)
                    yield record_bytes(page_id, url, payload, kind, refers_to, date)

        stream = encoded()
        while (first := next(stream, None)) is not None:
            name, count, size, stream = _file(root, itertools.chain([first], stream), max_bytes)
            yield pa.RecordBatch.from_pylist([{"path": f"{root}/{name}", "records": count, "bytes": size}])

    store, path = fs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    chosen = records.select("page_id", "url", "payload", "record_type", "refers_to")
    return scratch.keep(chosen.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def _frames(path: str) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each frame; reads ``READ_BYTES`` at a time."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name, compression=None) as source:
        data = source.read(8)
        trained, at = None, 0
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
            size = struct.unpack("<I", data[4:])[0]
            content = source.read(size)
            if len(content) != size:
                raise ValueError("the dictionary frame is cut off")
            if content[:4] == FRAME_MAGIC:
                content = zstandard.ZstdDecompressor().decompress(content)
            trained, at, data = zstandard.ZstdCompressionDict(content), 8 + size, b""
        decompressor = zstandard.ZstdDecompressor(dict_data=trained)
        while data or (data := source.read(READ_BYTES)):
            frame, out, used = decompressor.decompressobj(), [], 0
            while True:
                out.append(frame.decompress(data))
                used += len(data)
                if frame.eof:
                    break
                if not (data := source.read(READ_BYTES)):
                    raise ValueError("the last frame is cut off")
            data = frame.unused_data
            yield at, b"".join(out)
            at += used - len(data)


def parsed(content: bytes) -> dict:
    """The record of one frame, checked: version, required fields, lengths and digests."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"malformed header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = [name for name in REQUIRED if name.lower() not in fields]
    if missing:
        raise ValueError(f"missing {', '.join(missing)}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the length of the block is not as declared, or the frame has more than one record")
    block = rest[:-4]
    declared = fields.get("warc-block-digest")
    if declared and declared.startswith("sha1:") and declared[5:] != digest_text(block):
        raise ValueError("the block digest does not fit")
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response" and digest and digest != digest_text(payload):
        raise ValueError("the payload digest does not fit")
    page = fields.get("page-id")
    return {
        "record_type": fields["warc-type"],
        "record_id": fields["warc-record-id"],
        "page_id": int(page) if page else None,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to"),
        "payload_digest": digest,
        "payload": payload,
        "payload_bytes": len(payload),
    }


_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("refers_to_id", pa.string()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("error", pa.string()),
    ]
)
_SQL_SCHEMA = (
    "path string, offset long, record_type string, record_id string, page_id long, target_uri string, "
    "refers_to_id string, payload_digest string, payload binary, payload_bytes long, error string"
)


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives ``files`` (path), with its offset; a file is one task's work.

    A frame that is no valid record gives a row with ``error``, and reading goes on; a frame that can't be decoded
    ends its file with such a row. ``with_payload=False`` checks payloads but leaves them out.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in _records(path):
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if held >= READ_BYTES or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    paths = files.select("path").where("path is not null")
    # A partition for each file by number: paths are few bytes, and adaptive execution would merge their partitions.
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(read, _SQL_SCHEMA)


def _records(path: str) -> Iterator[dict]:
    at = 0
    try:
        for at, content in _frames(path):
            try:
                yield {"path": path, "offset": at, **parsed(content)}
            except ValueError as error:
                yield {"path": path, "offset": at, "error": str(error)}
    except (ValueError, zstandard.ZstdError) as error:
        yield {"path": path, "offset": at, "error": f"unreadable from here: {error}"}


def resolved(records: DataFrame) -> DataFrame:
    """Records read back, with the page that each revisit refers to and the length of the full payload."""
    targets = (
        records.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_id"))
        .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("full_bytes"))
    )
    return records.join(targets, "refers_to_id", "left").withColumn(
        "payload_bytes", F.coalesce("full_bytes", "payload_bytes")
    ).drop("full_bytes")
