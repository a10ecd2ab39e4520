"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Records with equal payloads: that with the smallest id is the response, the others are revisits that refer to it.
Archives are files in the shared folder; each task writes its own, so a repeated task leaves at most an unlisted file.

Defined results: a null html is an empty payload. Rows with the same id are records of their own; of equal payloads
under the same id only the first written would be told apart, so all of them are responses. Rows without an id are
records without a number: revisits of the response with an id if their payload has one, else responses that nothing refers
to. Other columns are ignored. The reader raises ValueError on a bad or missing header, length or digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import fresh_path, materialise

# The magic numbers of a skippable frame with a dictionary, and of a frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 64 << 20
# Bounded sample from which each archive's dictionary is made.
DICTIONARY_PAGES, DICTIONARY_BYTES = 64, 32 << 10

# Header fields that the reader needs.
REQUIRED = ("WARC-Record-ID", "WARC-Target-URI", "WARC-Type", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Length")

RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Target-URI: " + "".join(c if c.isprintable() else "%20" for c in url),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """One record, its header, lengths and digests held against each other."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1" or not mark:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines if ": " in line)
    missing = [name for name in REQUIRED if name not in fields]
    if missing:
        raise ValueError(f"the record has no {', '.join(missing)}")
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length is not that of its header")
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1])
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError("the payload is not that of its header")
    if kind not in ("response", "revisit"):
        raise ValueError(f"unexpected record type {kind}")
    number = lambda key: int(fields[key][len("<urn:page:") : -1]) if fields.get(key, _name(None)) != _name(None) else None
    return number("WARC-Record-ID"), fields["WARC-Target-URI"], kind, number("WARC-Refers-To"), size, said, payload if kind == "response" else None


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri)


def _archive(fs, path: str, rows: list[tuple]) -> None:
    sample = b"".join(p[-2048:] for _, _, p, r in rows[:DICTIONARY_PAGES] if r is None)[-DICTIONARY_BYTES:]
    dictionary = zstandard.ZstdCompressionDict(sample or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    leading = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
    with fs.open_output_stream(path, compression=None) as out:
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(leading)) + leading)
        for page_id, url, payload, refers_to in rows:
            out.write(packer.compress(record(page_id, url, payload, refers_to)))


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    # Only digests that repeat are kept; the join deals with few rows, and splits what is skewed.
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.max(F.col("page_id").isNull()).alias("nameless"))
    repeated = materialise(first.filter("first < last or nameless and first is not null").select("digest", "first"), "payloads")
    joined = keyed.join(repeated, "digest", "left")
    return joined.select("page_id", "url", "html", F.when((F.col("first") < F.col("page_id")) | F.col("page_id").isNull(), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; (path, records) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        rows, size = [], 0

        def put() -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            _archive(fs, path, rows)
            return pa.RecordBatch.from_pydict({"path": [path.rsplit("/", 1)[1]], "records": pa.array([len(rows)], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                rows.append((page_id, url, payload, refers_to))
                size += len(payload) + 1024
                if size >= archive_bytes:
                    yield put()
                    rows, size = [], 0
        if rows:
            yield put()

    return materialise(with_revisits(pages).mapInArrow(run, "path string, records bigint"), "archives")


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one frame after the other; bounded by the largest record."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    leading = stream.read(size)
    content = zstandard.ZstdDecompressor().decompress(leading) if leading[:4] == FRAME_MAGIC else leading
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO))
    rest = b""
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            return
        one, out = unpacker.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise ValueError("the archive ends inside a frame")
            out.append(one.decompress(rest))
            rest = one.unused_data
        yield b"".join(out)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the listed archives, validated."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen, size = [], 0, 0
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for data in frames(stream):
                        rows.append(parsed(data))
                        seen += 1
                        size += len(data)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, size = [], 0
                if seen != n:
                    raise ValueError(f"{path} holds {seen} records, not {n}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    spread = archives.select("path", "records").repartition(archives.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
