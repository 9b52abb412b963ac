"""Operator 12, WARC: Zstandard archives written and read on executors.

An archive is a ``.warc.zst`` stream: a skippable frame with the dictionary (itself compressed), then one frame per
record: warcinfo, responses and revisits. Records with equal payloads are found by their SHA-256: the one of smallest key is
the response, the others are revisits that refer to it and hold its HTTP headers only, so their ``Content-Length`` still
tells the length of the whole payload.

Writing: a first pass over the rows aggregates payload hashes (map-side first), a second makes the records. Payloads are not
shuffled as long as the repeated hashes, which are counted, fit ``BROADCAST_KEYS``; beyond that rows meet them in a join that
spreads hot payloads. Each task cuts its rows into archives of about ``ARCHIVE_BYTES`` of records, trains a dictionary on
records spread evenly over the archive (at most ``SAMPLE_BYTES`` of them; it only changes the archive's size) and hands the
archive to Spark as one row. Spark's own text writer commits it as a file of its own: the line separator it adds at the
end is an empty skippable frame. So a lost executor costs a task attempt and no part of an archive.

Reading: Spark reads each file as a row. The reader loads the dictionary, finds the end of every frame from its block
headers, decodes one frame at a time, and checks version line, named fields, lengths, block and payload digests.

Defined results: NULL payloads are empty ones; NULL keys are kept (a record id of their own) and refer to the smallest key of
their payload; rows that repeat the smallest key of a payload are all responses; rows of equal key and different payloads are
records of their own; NULL addresses leave the field out; an empty table gives no archives. A payload longer than
``ARCHIVE_BYTES`` has an archive of its own. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contest_panel.llm.common import to_arrow
from contest_panel.llm.graph import stored
from contest_panel.operators.skew import BROADCAST_KEYS, hot_keys, join_on_key
from contest_panel.session import checkpoint_folder, row_count_up_to, ship

#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 32_000_000
SAMPLE_BYTES = 1_000_000
DICTIONARY_BYTES = 32_768
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the formats.
FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame: what Spark's text writer adds after an archive.
_END = struct.pack("<II", SKIPPABLE[0], 0).decode("ascii")
_NULL_KEY = ":null"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(key: str | None) -> str:
    """Record id of a key in text form."""
    return f"<urn:page:{_NULL_KEY if key is None else quote(key, safe='')}>"


def key_of(name: str, kind: str) -> Column:
    """The key in a column of record ids, as ``kind``; NULL for records without one."""
    text = F.regexp_extract(name, "^<urn:page:(.*)>$", 1)
    return F.when(F.col(name).startswith("<urn:page:") & (text != _NULL_KEY), F.url_decode(text).try_cast(kind))


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, named fields, block."""
    named = [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in named)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response, or a revisit if ``refers_to`` names the response's record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if refers_to:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    return record(fields, http if refers_to else http + payload)


def archive(records: list[bytes], level: int = LEVEL, dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """The records as frames, after the dictionary trained on a share of them (none if there are too few)."""
    import zstandard

    dictionary = None
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, records[::step], k=256, d=8)
        dictionary = zstandard.ZstdCompressionDict(trained.as_bytes(), dict_type=zstandard.DICT_TYPE_FULLDICT)
    except zstandard.ZstdError:
        pass  # too few or too short records to learn from
    out = []
    if dictionary:
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
        out.append(struct.pack("<II", DICTIONARY, len(packed)) + packed)
        dictionary.precompute_compress(level=level)
    made = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    out += [made.compress(r) for r in records]
    return b"".join(out)


def write_archives(
    frame: DataFrame,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    folder: str | None = None,
    least: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = DATE,
    broadcast_keys: int = BROADCAST_KEYS,
) -> str:
    """Write the rows as archives and return their folder (by default a new one in the session's shared folder). Actions.

    Payloads of fewer than ``least`` bytes are never revisits.
    """
    spark = frame.sparkSession
    ship(spark)
    folder = folder or f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = frame.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary")).alias("payload")
    ).withColumn("hash", F.unhex(F.sha2("payload", 256)))
    sized = rows.filter(F.octet_length("payload") >= least) if least else rows
    seen = sized.groupBy("hash").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = stored(seen.filter("n > 1").drop("n"))
    if row_count_up_to(repeated, broadcast_keys) <= broadcast_keys:
        told = rows.join(F.broadcast(repeated), "hash", "left")
    else:
        told = join_on_key(rows.withColumn("spread", F.xxhash64("key", "url")), repeated, "hash", "left", hot_keys(rows, "hash"), "spread")
    text = lambda name: F.col(name).cast("string").alias(name)
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    told = told.select(text("key"), "url", "payload", F.when(again, F.col("first")).cast("string").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0

        def close() -> pa.RecordBatch:
            nonlocal records, size
            named = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
            made = archive([record(named, b"format: WARC File Format 1.1\r\n"), *records])
            records, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["archive"])

        for batch in batches:
            for own, address, body, first in zip(*(batch.column(i) for i in range(4))):
                made = page_record(own.as_py(), address.as_py(), body.as_py(), None if first.as_py() is None else record_id(first.as_py()), date)
                if records and size + len(made) > archive_bytes:
                    yield close()
                records.append(made)
                size += len(made)
        if records:
            yield close()

    archives = told.mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("lineSep", _END).option("maxRecordsPerFile", 1).text(folder)
    return folder


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by the sizes in its block headers."""
    import zstandard

    head = bytes(data[at : at + 18])
    checksum = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    last = False
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
        if at > len(data):
            raise ValueError("frame is cut off")
    at += 4 * checksum
    if at > len(data):
        raise ValueError("frame is cut off")
    return at


def read_frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of each record's frame. The dictionary comes from the leading skippable frame, if there is one."""
    import zstandard

    view, at, decoder, known = memoryview(data), 0, zstandard.ZstdDecompressor(), 0
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError(f"byte {at}: frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise ValueError(f"byte {at}: frame is cut off")
            if not at and magic == DICTIONARY:
                content = data[8 : 8 + size]
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
                decoder, known = zstandard.ZstdDecompressor(dict_data=dictionary), dictionary.dict_id()
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"byte {at}: no frame")
        try:
            end = frame_end(view, at)
            wanted = zstandard.get_frame_parameters(data[at : at + 18]).dict_id
            if wanted and wanted != known:
                raise ValueError(f"dictionary {wanted} is not the archive's")
            one = decoder.decompressobj()
            content = one.decompress(view[at:end])
            if not one.eof:
                raise ValueError("frame is cut off")
        except (zstandard.ZstdError, ValueError) as error:
            raise ValueError(f"byte {at}: {error}") from error
        yield at, end - at, content
        at = end


def parse_record(raw: bytes) -> dict:
    """A checked record: its fields by lower-case name, block, and payload with the length of the whole payload."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line or end of header")
    fields: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] = f"{fields[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError(f"not a named field: {line[:80]!r}")
        if name in fields and name != "warc-concurrent-to":
            raise ValueError(f"field {name} is given twice")
        fields[name] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise ValueError(f"field {needed} is missing")
    if not (fields["content-length"].isascii() and fields["content-length"].isdigit()):
        raise ValueError("Content-Length is no number")
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length}, but {len(rest) - 4} bytes before the end")
    _check_digest(fields.get("warc-block-digest"), block, "block")
    payload, whole = None, None
    if fields.get("content-type", "").replace(" ", "").startswith("application/http;msgtype=response"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        named = dict(line.lower().split(b":", 1) for line in http.split(b"\r\n")[1:] if b":" in line)
        told = named.get(b"content-length", b"").strip()
        whole = int(told) if told.isdigit() else len(payload)
        if fields["warc-type"] == "revisit":
            if payload:
                raise ValueError("a revisit with a payload")
            if "warc-refers-to" not in fields or "warc-profile" not in fields:
                raise ValueError("a revisit without profile or reference")
        else:
            if "warc-truncated" not in fields and whole != len(payload):
                raise ValueError(f"HTTP Content-Length {whole}, but a payload of {len(payload)} bytes")
            _check_digest(fields.get("warc-payload-digest"), payload, "payload")
    return {"fields": fields, "block": block, "payload": payload, "payload_bytes": whole}


def _check_digest(told: str | None, data: bytes, what: str) -> None:
    if told and told.lower().startswith("sha1:") and told[5:].upper() != base32_sha1(data):
        raise ValueError(f"{what} digest doesn't match")


_SCHEMA = (
    "path string, number int, offset long, size long, record_type string, record_id string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, refers_to string, payload binary, problem string"
)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False, strict: bool = True) -> DataFrame:
    """One row per record of the archives in ``folder``. ``payload`` is filled only if asked for.

    A record that isn't valid ends the job with its place; without ``strict`` it is a row whose ``problem`` says what is
    wrong. After a broken frame the rest of that archive can't be found, so its row is the archive's last.
    """
    ship(spark)
    wanted = to_arrow(_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows: list[tuple] = []
                for row in _records(path.as_py(), content.as_py(), payloads, strict):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield _batch(rows, wanted)
                        rows = []
                if rows:
                    yield _batch(rows, wanted)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple], wanted: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), wanted)], schema=wanted)


def _records(path: str, data: bytes, payloads: bool, strict: bool) -> Iterator[tuple]:
    number, frames = 0, read_frames(data)
    while True:
        offset = size = None
        try:
            at = next(frames, None)
            if at is None:
                return
            offset, size, raw = at
            found = parse_record(raw)
            fields = found["fields"]
            digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
            of = fields.get
            yield (
                path, number, offset, size, of("warc-type"), of("warc-record-id"), of("warc-target-uri"), of("warc-date"),
                digest, found["payload_bytes"], of("warc-refers-to"), found["payload"] if payloads else None, None,
            )
        except (ValueError, UnicodeDecodeError) as error:
            if strict:
                raise ValueError(f"{path}, record {number}: {error}") from error
            yield (path, number, offset, size, *[None] * 8, str(error))
        number += 1
