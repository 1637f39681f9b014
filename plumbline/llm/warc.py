"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Writing: rows are dealt over archives of about ARCHIVE_BYTES, written by the executors under the shared
folder, each under a name of its attempt. What is read back are the archives that the attempts that ended
well have returned, so a task that dies, or runs twice, adds no record. The dictionary is trained on the archive's own first records. Of equal payloads of at least
MIN_REVISIT bytes the one with the smallest page_id is a response; the others are revisit records, whose
block holds only the HTTP header (with the payload's length) and refer to it.

Reading: an archive is read in slices, so it may be of any size; a record is held in memory. The dictionary comes from the leading skippable frame; every further frame is decoded on its own and
must hold exactly one record, whose version line, mandatory headers, block length and payload digest are
checked. A frame that fails raises ValueError with the archive's name and the frame's offset.

Edge cases: a null html has an empty payload; a null url or page_id leaves its header out. Rows that share
the smallest page_id of a group are all responses. Equal rows are written as often as they occur. A payload
of any length is one frame. An empty table gives no archive and no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
#: Fixed values of the format: the skippable frame of the dictionary, a data frame, and a dictionary.
DICT_FRAME, DATA_FRAME, DICT_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
DICT_BYTES, SAMPLE_RECORDS = 16 << 10, 200
#: Bytes read of an archive at a time.
SLICE = 16 << 10
DATE = "2024-01-01T00:00:00Z"


def roles(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload digest, record_type and refers_to. A hot payload is pre-aggregated, and its join can be split."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("long", F.octet_length("html") >= MIN_REVISIT)
    first = rows.where("long").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there is too little to train on."""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:]


def archive(records: Iterator[bytes], sink) -> int:
    """Writes records to sink as one archive; returns their number."""
    head = [r for _, r in zip(range(SAMPLE_RECORDS), records, strict=False)]
    if not head:
        return 0
    made = dictionary([h[:8192] for h in head])
    coder = zstd.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, dict_data=zstd.ZstdCompressionDict(made, dict_type=zstd.DICT_TYPE_FULLDICT if made[:4] == struct.pack("<I", DICT_MAGIC) else zstd.DICT_TYPE_RAWCONTENT))
    sink.write(struct.pack("<II", DICT_FRAME, len(made)) + made)
    n = 0
    for part in (head, records):
        for r in part:
            sink.write(coder.compress(r))
            n += 1
    return n


class Invalid(ValueError):
    """A frame or record that breaks the format."""


def parse(raw: bytes, where: str) -> dict:
    """A record's headers (lower-case names), HTTP headers and payload; raises Invalid where it breaks the format."""
    head, split, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not split or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Invalid(f"{where}: no WARC version line or no end of headers")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Invalid(f"{where}: header without a colon")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Invalid(f"{where}: header {name} is missing")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise Invalid(f"{where}: the block is not as long as its header says")
    block = rest[:-4]
    if (told := fields.get("warc-block-digest")) and told != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise Invalid(f"{where}: the block has another digest")
    http, split, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not split or length is None:
        raise Invalid(f"{where}: no HTTP header with a length")
    digest = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "response" and (length != len(payload) or digest != f"sha256:{hashlib.sha256(payload).hexdigest()}"):
        raise Invalid(f"{where}: the payload has another length or digest")
    return {"fields": fields, "payload_bytes": length, "payload_digest": digest.removeprefix("sha256:"), "payload": payload}


def frames(source, where: str) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame behind the dictionary's. source: bytes, or an open file, which is read in slices."""
    if not hasattr(source, "read"):
        source = io.BytesIO(source)
    head = source.read(8)
    if len(head) < 8 or struct.unpack_from("<I", head)[0] != DICT_FRAME:
        raise Invalid(f"{where}: no leading dictionary frame")
    size = struct.unpack_from("<I", head, 4)[0]
    made = source.read(size)
    if len(made) != size:
        raise Invalid(f"{where}: the dictionary frame is cut off")
    if made[:4] == struct.pack("<I", DATA_FRAME):
        made = zstd.ZstdDecompressor().decompress(made)
    kind = zstd.DICT_TYPE_FULLDICT if made[:4] == struct.pack("<I", DICT_MAGIC) else zstd.DICT_TYPE_RAWCONTENT
    coder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(made, dict_type=kind))
    at, held = 8 + size, source.read(SLICE)
    while held:
        if len(held) < 4:
            held += source.read(SLICE)
        if len(held) < 4 or struct.unpack_from("<I", held)[0] != DATA_FRAME:
            raise Invalid(f"{where}: no frame at {at}")
        one, out, fed = coder.decompressobj(), [], 0
        try:
            while held and not one.eof:
                out.append(one.decompress(held))
                fed += len(held)
                held = one.unused_data if one.eof else source.read(SLICE)
        except zstd.ZstdError as e:
            raise Invalid(f"{where}: frame at {at}: {e}") from e
        if not one.eof:
            raise Invalid(f"{where}: the frame at {at} is cut off")
        yield at, b"".join(out)
        at += fed - len(held)
        held = held or source.read(SLICE)


def opened(path: str):
    """(file system, path within it)."""
    return (pafs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if path.startswith(("file:", "/")) else pafs.FileSystem.from_uri(path)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes roles(pages) as archives under folder; one row an archive: path, n_records. Lazy: the write happens when it is read.

    The rows are the archives of the attempts that ended well. What others leave has other names and is never read.
    """

    def run(batches):
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        from pyspark import TaskContext

        task, k = TaskContext.get(), 0

        def records(left):
            for batch in left:
                for i in range(batch.num_rows):
                    page_id, url, html, digest, kind, first = (c[i].as_py() for c in batch.columns)
                    yield record(page_id, url, html.encode(), digest, kind, first)

        left = records(batches)
        while True:
            budget = [ARCHIVE_BYTES]

            def some(budget=budget):
                while budget[0] > 0 and (r := next(left, None)) is not None:
                    budget[0] -= len(r)
                    yield r

            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.zst"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as sink:
                n = archive(some(), sink)
            if not n:
                fs.delete_file(f"{base}/{name}")
                return
            k += 1
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "n_records"])

    return pages.mapInArrow(run, "path string, n_records long")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string, frame_at long"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of archives(path): READ, without the payloads' bytes if payloads is False."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = opened(path)
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(place, compression=None) as source:
                    for at, one in frames(source, path):
                        r = parse(one, f"{path}: frame at {at}")
                        f = r["fields"]
                        number = lambda name: int(f[name]) if name in f else None  # noqa: B023, E731
                        rows.append((number("warc-page-id"), f.get("warc-target-uri"), r["payload_bytes"], r["payload_digest"], f["warc-type"], number("warc-refers-to-page-id"), r["payload"] if payloads else None, path, at))
                        size += len(r["payload"]) * payloads + 200
                        if size > 4 << 20:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "archive", "frame_at"]
    return archives.select("path").mapInArrow(run, READ)


def op2_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    archives = C.written(write(roles(C.table(spark, sf_dir, "pages")), C.new_path(spark, "warc")), "archives")
    # An archive is a task.
    return read(archives.repartition(max(1, archives.count())), payloads=False).drop("url", "payload", "archive", "frame_at")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
