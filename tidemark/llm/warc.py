"""WARC archives compressed with Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writing: pages of equal payload (at least MIN_REVISIT bytes) share one response, that of the largest page_id; the others
become revisit records, which hold the HTTP header but no payload. Each task writes archives of its own into the
shared folder, trains the dictionary of an archive on its first records, and reports what it finished; an archive of a
task that was lost or repeated is in no report and is never read.

Reading: the reported archives are dealt to tasks. A task streams an archive, loads its dictionary, decodes frame by frame
and checks of each record: one record fills the frame; the version line; the lengths of block and payload; the
digest of a response's payload. A fault raises an error that names the archive.

Null html is an empty payload; a null url is left out of the record; a null page_id gives a record without one, read back
as null, which refers to its group's response and is none itself unless all are null. Of equal rows (and rows of
one page_id) with the largest page_id each is a response. Empty tables give no archives and an empty result;
further columns are ignored. Folders are opened by pyarrow.fs, so any file system it knows will do.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import work_folder, written

MIN_REVISIT = 1000
#: Salts that spread the pages of one payload over tasks where its response is looked up.
SALTS = 32
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 16 << 10, 128, 4096
#: Fixed values of the formats: the dictionary's skippable frame, the start of a frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisits/identical-payload-digest"
READ_BYTES = 1 << 18


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of ``refers_to``."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = page_id if page_id is not None else f"none:{uuid.uuid4().hex}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of one record, after checks of version, lengths and digest."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes; its header says {length}")
    http, mark, payload = rest[:length].partition(b"\r\n\r\n")
    status, *more = http.decode().split("\r\n")
    if not mark or not status.startswith("HTTP/"):
        raise ValueError("no HTTP header in the block")
    size = int({k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in more)}["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload that does not match its length or digest")
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a payload")
    page = lambda urn: int(x) if (x := urn.strip("<>").removeprefix("urn:x-page:")).lstrip("-").isdigit() else None
    return {"page_id": page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload if kind == "response" else None}


def _trained(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; empty if they are too few or too small for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s[:SAMPLE_BYTES] for s in samples]).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: Iterable[bytes], out, size: int = ARCHIVE_BYTES) -> int:
    """Write records as one archive until they end or it reaches ``size``; the number written."""
    import zstandard

    records = iter(records)
    ahead = [r for _, r in zip(range(SAMPLES), records)]
    dictionary = _trained(ahead)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True) if dictionary else zstandard.ZstdCompressor(level=3, write_checksum=True)
    packed = zstandard.ZstdCompressor().compress(dictionary) if dictionary else b""
    at = out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed) or 0
    n = 0

    def frames() -> Iterator[bytes]:
        yield from (compressor.compress(r) for r in ahead)
        while at < size and (r := next(records, None)) is not None:
            yield compressor.compress(r)

    for frame in frames():
        out.write(frame)
        at += len(frame)
        n += 1
    return n


def decoded(stream) -> Iterator[bytes]:
    """The records of one archive, a frame at a time; ``stream`` has read(n)."""
    import zstandard

    head = stream.read(8)
    dictionary, left = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        want, left = struct.unpack("<I", head[4:])[0], b""
        packed = stream.read(want)
        if len(packed) != want:
            raise ValueError("the dictionary's frame is cut short")
        if packed.startswith(FRAME_MAGIC):
            packed = zstandard.ZstdDecompressor().decompress(packed)
        if packed:
            dictionary = zstandard.ZstdCompressionDict(packed)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        chunk = left or stream.read(READ_BYTES)
        if not chunk:
            return
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(chunk))
            if frame.eof:
                left = frame.unused_data
                break
            chunk = stream.read(READ_BYTES)
            if not chunk:
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def classified(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to`` of every page: the page whose response holds its payload, or null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html"))
    digest = F.when(F.col("size") >= MIN_REVISIT, F.sha2(F.col("html").cast("binary"), 256))
    keyed = rows.withColumn("digest", digest).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    groups = keyed.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("digest", "largest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = keyed.join(groups, ["digest", "salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives of all pages; ``path, records, bytes`` of each that was finished."""
    folder = folder or f"{work_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    yield record(row[0], row[1], row[2].encode(), row[3])

        rows, number = records(), 0
        for first in rows:
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                n = archive(_after(first, rows), out)
                size = out.tell()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})
            number += 1

    return written(classified(pages).mapInArrow(write, "path string, records long, bytes long"), "archives")


def _after(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` [, ``payload``] of every record in ``archives`` (path, records)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], list(kinds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        for batch in batches:
            for path, n in zip(*(c.to_pylist() for c in batch.columns)):
                files, name = fs.FileSystem.from_uri(path)
                rows, count = [], 0
                try:
                    with files.open_input_stream(name, compression=None) as stream:
                        for raw in decoded(stream):
                            rows.append(parsed(raw))
                            count += 1
                            if len(rows) == 500:
                                yield batch_of(rows)
                                rows = []
                    if count != n:
                        raise ValueError(f"{count} records; {n} were written")
                except (ValueError, KeyError, zstandard.ZstdError) as e:
                    raise ValueError(f"{path}: {f'no header {e}' if isinstance(e, KeyError) else e}") from e
                if rows:
                    yield batch_of(rows)

    tasks = min(10_000, max(1, archives.count()))
    return archives.select("path", "records").repartition(tasks).mapInArrow(read, schema)
