"""The record batches of an Arrow IPC shard, found by their headers alone.

Both formats are a row of messages: a short header that tells the size of the body, then the body. So the batches of
a byte range can be found without reading other batches: the stream format by going from header to header over the
bodies, the file format by the list in its footer. A header also holds what the writer noted about its batch.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa

#: Fixed values of the format.
FILE_MAGIC = b"ARROW1"
CONTINUATION = b"\xff\xff\xff\xff"
SCHEMA, DICTIONARY, RECORD_BATCH = 1, 2, 3
END = CONTINUATION + bytes(4)
#: Bytes read at a header; longer ones are read once more.
HEADER_BYTES = 4096
#: Key under which a batch's statistics stand in its header.
STATS_KEY = b"stats"
#: Longer strings are left out of the statistics.
STATS_CHARS = 64


class _Table:
    """A table of the header's encoding: fields are found through a list of offsets."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def _field(self, number: int) -> int | None:
        fields = self.at - struct.unpack_from("<i", self.data, self.at)[0]
        place = 4 + 2 * number
        if place >= struct.unpack_from("<H", self.data, fields)[0]:
            return None
        offset = struct.unpack_from("<H", self.data, fields + place)[0]
        return self.at + offset if offset else None

    def number(self, field_number: int, kind: str) -> int:
        at = self._field(field_number)
        return struct.unpack_from(f"<{kind}", self.data, at)[0] if at else 0

    def _target(self, field_number: int) -> int | None:
        at = self._field(field_number)
        return at + struct.unpack_from("<I", self.data, at)[0] if at else None

    def table(self, field_number: int) -> _Table | None:
        at = self._target(field_number)
        return _Table(self.data, at) if at else None

    def vector(self, field_number: int) -> tuple[int, int]:
        """Place of the first element, and how many there are."""
        at = self._target(field_number)
        return (at + 4, struct.unpack_from("<I", self.data, at)[0]) if at else (0, 0)

    def text(self, field_number: int) -> bytes:
        at, size = self.vector(field_number)
        return self.data[at : at + size]


@dataclass
class Header:
    """One message: its kind, where it stands, the sizes of header and body, rows, and statistics per column."""

    kind: int
    offset: int
    head: int
    body: int
    rows: int = 0
    stats: dict = field(default_factory=dict)
    number: int = 0

    @property
    def size(self) -> int:
        return self.head + self.body


def _described(data: bytes, offset: int, head: int) -> Header:
    message = _Table(data, struct.unpack_from("<I", data, 0)[0])
    header = Header(message.number(1, "B"), offset, head, message.number(3, "q"))
    if header.kind == RECORD_BATCH:
        header.rows = message.table(2).number(0, "q")
        at, count = message.vector(4)
        for i in range(count):
            place = at + 4 * i
            entry = _Table(data, place + struct.unpack_from("<I", data, place)[0])
            if entry.text(0) == STATS_KEY:
                header.stats = json.loads(entry.text(1))
    return header


def read_header(source: pa.NativeFile, offset: int) -> Header | None:
    """The header of the message at `offset`; None at the end of the messages."""
    source.seek(offset)
    data = source.read(HEADER_BYTES)
    skip = 8 if data[:4] == CONTINUATION else 4
    if len(data) < skip:
        return None
    size = struct.unpack_from("<i", data, skip - 4)[0]
    if size <= 0:
        return None
    if len(data) < skip + size:
        data += source.read(skip + size - len(data))
    if len(data) < skip + size:
        raise ValueError(f"cut off in a header at byte {offset}")
    return _described(data[skip : skip + size], offset, skip + size)


class Shard:
    """One open shard. A stream that ends within a message, or a file without its footer, is an error."""

    def __init__(self, source: pa.NativeFile, size: int):
        self.source, self.size = source, size
        source.seek(0)
        self.is_file = source.read(len(FILE_MAGIC)) == FILE_MAGIC
        self.begin = 8 if self.is_file else 0
        first = read_header(source, self.begin)
        if first is None or first.kind != SCHEMA:
            raise ValueError("not an Arrow shard")
        self.prefix = self.bytes_of(first)
        self.schema = pa.ipc.read_schema(pa.py_buffer(self.prefix))
        self.after_schema = self.begin + first.size
        self._reader: tuple | None = None

    def bytes_of(self, header: Header) -> bytes:
        if header.offset + header.size > self.size:
            raise ValueError(f"cut off in the message at byte {header.offset}")
        self.source.seek(header.offset)
        return self.source.read(header.size)

    def _footer(self) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Blocks (offset, header, body) of dictionaries and of record batches."""
        tail = 4 + len(FILE_MAGIC)
        self.source.seek(self.size - tail)
        end = self.source.read(tail)
        if end[4:] != FILE_MAGIC:
            raise ValueError("cut off: the file has no footer")
        length = struct.unpack_from("<i", end, 0)[0]
        self.source.seek(self.size - tail - length)
        data = self.source.read(length)
        root = _Table(data, struct.unpack_from("<I", data, 0)[0])

        def blocks(number: int) -> list[tuple[int, int, int]]:
            at, count = root.vector(number)
            return [struct.unpack_from("<qi4xq", data, at + 24 * i) for i in range(count)]

        return blocks(2), blocks(3)

    def headers(self, start: int = 0, stop: int | None = None, rows_before: bool = True) -> Iterator[tuple[int | None, Header]]:
        """`(first row, header)` of the record batches that begin from `start` to before `stop`.

        Without `rows_before` the footer of a file leads straight there, and the first row is unknown.
        """
        stop = self.size if stop is None else stop
        first = 0
        if self.is_file:
            dictionaries, batches = self._footer()
            for offset, head, body in dictionaries:
                self.prefix += self.bytes_of(Header(DICTIONARY, offset, head, body))
            for number, (offset, _, _) in enumerate(batches):
                if offset >= stop or (offset < start and not rows_before):
                    continue
                header = read_header(self.source, offset)
                header.number = number
                if offset >= start:
                    yield (first if rows_before else None), header
                first += header.rows
            return
        offset = self.after_schema
        while offset < stop and (header := read_header(self.source, offset)):
            if header.offset + header.size > self.size:
                raise ValueError(f"cut off in the message at byte {header.offset}")
            if header.kind == DICTIONARY:
                self.prefix += self.bytes_of(header)
            elif header.kind == RECORD_BATCH:
                if offset >= start:
                    yield first, header
                first += header.rows
            offset += header.size

    def batch(self, header: Header, columns: list[str]) -> pa.RecordBatch:
        """Some columns of one batch. Of a file, only the bytes of these columns are read."""
        wanted = [self.schema.names.index(c) for c in columns if c in self.schema.names]
        options = pa.ipc.IpcReadOptions(included_fields=sorted(wanted) or [0])
        if self.is_file:
            if self._reader is None or self._reader[0] != wanted:
                self._reader = wanted, pa.ipc.open_file(self.source, options=options)
            return self._reader[1].get_batch(header.number)
        message = pa.py_buffer(self.prefix + self.bytes_of(header) + END)
        return pa.ipc.open_stream(message, options=options).read_next_batch()


def _plain(value):
    return value if isinstance(value, (bool, int, float)) or isinstance(value, str) and len(value) <= STATS_CHARS else None


def statistics(batch: pa.RecordBatch, columns: list[str] | None = None) -> dict[str, list]:
    """`{column: [least, largest, nulls]}` of the columns with plain values; without both ends if either is unfit."""
    import pyarrow.compute as pc

    out = {}
    for name in columns if columns is not None else batch.schema.names:
        column = batch.column(name)
        kind = column.type
        if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind)):
            continue
        ends = [_plain(v) for v in pc.min_max(column).as_py().values()]
        if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
            ends = [None, None]
        out[name] = [*(ends if None not in ends else [None, None]), column.null_count]
    return out
