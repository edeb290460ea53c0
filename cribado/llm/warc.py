"""WARC archives as seekable Zstandard bundles.

Tasks write their records in frames that can be decompressed by themselves; a table of the frames' sizes, in a
skippable frame, ends each bundle. The writer returns an index from record to bundle, frame and place in the
frame, so one record costs one frame to read. Bundles are written under a temporary name and moved when
complete; a repeated task writes the same content again.

Payloads that are repeated are stored once: by the record of the largest id; the others refer to it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.llm.common import parallelism
from cribado.session import fresh_path, materialize
from cribado.sources.files import replace, resolve

#: Smaller payloads are never replaced by a reference.
MIN_SHARED_BYTES = 1000
#: A frame or bundle ends with the record that fills it.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
#: Up to so many repeated payloads (about 60 bytes each) are broadcast.
BROADCAST_PAYLOADS = 500_000
#: Fixed values of the seekable format and of the WARC profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, archive string, frame int, offset long, length long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(name: str | None) -> int | None:
    number = name[len("<urn:page:") : -1] if name else ""
    return int(number) if number else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_name(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": quote(url, safe="%/:?#[]@!$&'()*+,;=-._~") if url else None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": PROFILE if refers_to is not None else None,
        "WARC-Refers-To": record_name(refers_to) if refers_to is not None else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse_records(data: bytes) -> Iterator[tuple]:
    """Rows of all records in a piece of archive; a payload that does not fit its digest is an error."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        fields = _fields(data[at : body - 4])
        end = body + int(fields["Content-Length"])
        http = data.index(b"\r\n\r\n", body) + 4
        payload, digest = data[http:end], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size, kind = int(_fields(data[body : http - 4])["Content-Length"]), fields["WARC-Type"]
        if kind == "response" and (size != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        yield (
            _page_of(fields["WARC-Record-ID"]),
            size,
            digest,
            kind,
            _page_of(fields.get("WARC-Refers-To")),
            payload if kind == "response" else None,
        )
        at = end + 4


class Bundle:
    """One archive being written."""

    def __init__(self, root: str, name: str):
        self.files, folder = resolve(root)
        self.path = f"{folder}/{name}"
        self.files.create_dir(folder)
        self.partial = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.out = self.files.open_output_stream(self.partial)
        self.sizes: list[tuple[int, int]] = []
        self.held, self.held_bytes, self.total = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame and place in it."""
        place = len(self.sizes), self.held_bytes
        self.held.append(record)
        self.held_bytes += len(record)
        self.total += len(record)
        if self.held_bytes >= FRAME_BYTES:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        if self.held:
            frame = zstandard.compress(b"".join(self.held), 3)
            self.out.write(frame)
            self.sizes.append((len(frame), self.held_bytes))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        replace(self.files, self.partial, self.path)


def frame_table(file) -> list[tuple[int, int]]:
    """Place and size of every compressed frame, from the table at the end of the file."""
    end = file.size()
    file.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * count)
    sizes = struct.unpack(f"<{2 * count}I", file.read(8 * count))[::2]
    places, at = [], 0
    for size in sizes:
        places.append((at, size))
        at += size
    return places


def repeated_payloads(pages: DataFrame, min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """`(key, keeper)` for each payload of at least `min_bytes` that several pages hold."""
    long = pages.filter(F.octet_length("payload") >= min_bytes)
    groups = long.groupBy(F.unhex(F.sha2("payload", 256)).alias("key")).agg(
        F.count("*").alias("n"), F.max("page_id").alias("keeper")
    )
    return groups.filter("n > 1 AND keeper IS NOT NULL").select("key", "keeper")


def _with_references(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Add `refers_to`: the keeper's id where another page keeps the payload."""
    repeated = materialize(repeated_payloads(pages, min_bytes))
    key = F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha2("payload", 256)))
    if repeated.count() <= BROADCAST_PAYLOADS:
        found = pages.withColumn("key", key).join(F.broadcast(repeated), "key", "left")
    else:
        members = pages.select("page_id", key.alias("key")).join(repeated, "key").select("page_id", "key", "keeper")
        members = members.distinct().select(F.col("page_id").alias("member_id"), F.col("key").alias("member_key"), "keeper")
        same = F.col("page_id").eqNullSafe(F.col("member_id")) & (key == F.col("member_key"))
        found = pages.join(members, same, "left")
    other = ~F.col("keeper").eqNullSafe(F.col("page_id"))
    return found.select("page_id", "url", "payload", F.when(other, F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """Write one record per row under `root` and return the index `page_id, archive, frame, offset, length`.

    NULL payloads are empty, NULL urls are left out, a NULL id is written as an empty name. Of equal payloads the row
    with the largest id is the response; rows with that same id are responses too, and so are all rows
    of a group that has no id. An empty table writes no archive. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bundle, count, index = TaskContext.get().partitionId(), None, 0, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    name = f"bundle-{part:06d}-{count:04d}.warc.zst"
                    bundle, count = Bundle(root, name), count + 1
                record = make_record(page_id, url, payload, refers_to)
                frame, offset = bundle.add(record)
                index.append((page_id, f"{root}/{name}", frame, offset, len(record)))
                if bundle.total >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
        if bundle:
            bundle.close()
        if index:
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*index), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "archive", "frame", "offset", "length"])

    return materialize(_with_references(rows, min_bytes).mapInArrow(run, _INDEX))


def _record_batches(rows: Iterator[tuple], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [part.split()[0] for part in _RECORD.split(", ")]
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    for row in rows:
        held.append(row if payloads else (*row[:-1], None))
        size += len(row[-1] or b"") if payloads else 0
        if len(held) >= 5000 or size >= BUNDLE_BYTES // 4:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


#: Tasks that read archives, at most.
READERS = 20_000


def _one_by_one(archives: DataFrame) -> DataFrame:
    """The names dealt out evenly: one archive a task, as long as there are not too many tasks."""
    names = materialize(archives.select("archive").distinct())
    readers = min(max(names.count(), 1), READERS)
    return names.repartitionByRange(readers, "archive")


class Reader:
    """One open archive and its last frame at a time."""

    def __init__(self):
        self.archive, self.file, self.frame = None, None, (None, b"")

    def open(self, archive: str) -> None:
        if archive != self.archive:
            self.close()
            files, path = resolve(archive)
            self.archive, self.file = archive, files.open_input_file(path)
            self.places, self.frame = frame_table(self.file), (None, b"")

    def read(self, number: int) -> bytes:
        if self.frame[0] != number:
            at, size = self.places[number]
            self.file.seek(at)
            self.frame = number, zstandard.decompress(self.file.read(size))
        return self.frame[1]

    def close(self) -> None:
        if self.file:
            self.file.close()


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives named in the column `archive`, each name once, frame by frame.

    Every archive is a task of its own. Other columns are not read; no names give no records.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader = Reader()
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                reader.open(archive)
                for number in range(len(reader.places)):
                    yield from parse_records(reader.read(number))
        reader.close()

    return _one_by_one(archives).mapInArrow(lambda batches: _record_batches(records(batches), payloads), _RECORD)


def fetch(index: DataFrame) -> DataFrame:
    """The records of some rows of an index. An archive is opened and its seek table read once per task, a frame is
    decompressed once for all records in it; a row that is there twice is fetched twice."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader = Reader()
        for batch in batches:
            for archive, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "frame", "offset", "length"))):
                reader.open(archive)
                yield from parse_records(reader.read(frame)[offset : offset + length])
        reader.close()

    places = index.select("archive", "frame", "offset", "length")
    dealt = places.repartitionByRange(parallelism(index), "archive", "frame").sortWithinPartitions("archive", "frame", "offset")
    return dealt.mapInArrow(lambda batches: _record_batches(records(batches), True), _RECORD)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_archives(pages, fresh_path(spark, "warc"))
    return read_archives(index, payloads=False).drop("payload")
