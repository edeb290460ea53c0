"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every byte becomes one printable character, so a vocabulary entry becomes a piece; its score is the negative
rank, so the best-scored merge is the one with the lowest rank. Normalisation is the identity. Each match of
the pre-token pattern is encoded by itself, and ids are decoded by the inverse mapping. The piece numbers
are the ranks; the unknown piece that the format asks for stands last and is never met, as each byte is
a piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens, and parts of texts, whose ids a task remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Ids or text bytes of one batch sent back to Spark.
BATCH = 2_000_000

BYTE_CHARS = {b: chr(0x100 + b) for b in range(256)}
CHAR_BYTES = {0x100 + b: b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes as length-delimited, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Ranks must be 0 to n-1, each once, and cover all single bytes."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0 to n-1, each once, and cover every byte")
    normal, unknown = 1, 2
    pieces = [(t.decode("latin-1").translate(BYTE_CHARS), float(-ranks[t]), normal) for t in tokens]
    pieces.append(("<unk>", 0.0, unknown))
    model = b"".join(
        _field(1, _field(1, piece.encode()) + _field(2, score) + _field(3, kind)) for piece, score, kind in pieces
    )
    bpe, nowhere = 2, (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    trainer += b"".join(_field(special, nowhere) for special in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return model + _field(2, trainer) + _field(3, normalizer)


#: Texts without characters from here on are split with Python's own regex engine, which is faster.
LATIN_END = 0x250


def latin_pattern(pattern: str) -> str | None:
    r"""`pattern` with \p{L}, \p{N}, \s and \S spelled out for characters below LATIN_END.

    None if it has other escapes or nested classes: then only the full engine will do.
    """
    import regex

    chars = [chr(c) for c in range(LATIN_END)]
    members = {
        r"\p{L}": [c for c in chars if unicodedata.category(c)[0] == "L"],
        r"\p{N}": [c for c in chars if unicodedata.category(c)[0] == "N"],
        r"\s": [c for c in chars if regex.match(r"\s", c)],
    }
    listed = {k: "".join(map(re.escape, v)) for k, v in members.items()}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part in listed:
            out.append(listed[part] if inside else f"[{listed[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{listed[r'\s']}]")
        elif part[0] == "\\" or part == "[" and inside:
            return None
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


#: Fixed value: the pattern for which texts may be taken apart at single spaces, see `Encoder`.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Encodes texts; keeps the ids of what it has met.

    With SPACED_PATTERN no match runs over a space between two characters that are none, a space can only stand first in a
    match that has others, and no match looks back. So the parts between such spaces, each with the space before it, are
    encoded by themselves, and remembered parts need no splitting. Texts where a space has another next to
    it, and other patterns, are split as a whole.
    """

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.split_any = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.split_latin = re.compile(latin).findall if latin else self.split_any
        self.beyond_latin = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]").search
        self.by_part = pattern == SPACED_PATTERN
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = {self.pieces.id_to_piece(i): i for i in range(self.pieces.get_piece_size() - 1)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        return (self.split_any if self.beyond_latin(text) else self.split_latin)(text)

    def encode_all(self, texts: list[str]) -> Iterator[Iterable[int]]:
        """The ids of each text; what is new in any of them is looked up first, all at once."""
        cut = [text.split(" ") if self.by_part else [text] for text in texts]
        self._learn_parts(set().union(*(parts[1:] for parts in cut)))
        plans = []
        for text, (first, *rest) in zip(texts, cut):
            found = list(map(self.parts.__getitem__, rest))
            as_whole = () in found or rest and first != first.rstrip()
            plans.append((self.split(text), ()) if as_whole else (self.split(first), found))
        self._meet(chain.from_iterable(tokens for tokens, _ in plans))
        for tokens, found in plans:
            yield chain.from_iterable(chain(map(self.known.__getitem__, tokens), found))

    def _learn_parts(self, wanted: set[str]) -> None:
        """Ids of parts that follow a space; no ids mark one that begins or ends with a space or is empty."""
        fresh = wanted.difference(self.parts)
        if len(self.parts) + len(fresh) > REMEMBERED:
            self.parts.clear()
            fresh = wanted
        clean = [p for p in fresh if p and p.strip() == p]  # str.strip takes off all that \s matches
        tokens = [self.split(f" {p}") for p in clean]
        self._meet(chain.from_iterable(tokens))
        ids = (tuple(chain.from_iterable(map(self.known.__getitem__, t))) for t in tokens)
        self.parts.update(dict.fromkeys(fresh, ()))
        self.parts.update(zip(clean, ids))

    def _meet(self, tokens: Iterable[str]) -> None:
        wanted = set(tokens)
        if fresh := wanted.difference(self.known):
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
                fresh = wanted
            self._learn(list(fresh))

    def _learn(self, tokens: list[str]) -> None:
        mapped = [t.encode().decode("latin-1").translate(BYTE_CHARS) for t in tokens]
        for token, piece, ids in zip(tokens, mapped, self.pieces.encode(mapped, out_type=int, num_threads=1)):
            # A pre-token that is itself an entry is this entry, whether merges lead to it or not.
            self.known[token] = (self.whole[piece],) if piece in self.whole else tuple(ids)


def decoding_table(model: bytes) -> list[bytes]:
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = (pieces.id_to_piece(i) for i in range(pieces.get_piece_size() - 1))
    return [name.translate(CHAR_BYTES).encode("latin-1") for name in names]


def _in_parts(sizes: list[int]) -> Iterator[slice]:
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > BATCH:
            yield slice(start, i)
            start, total = i, 0
        total += size
    yield slice(start, len(sizes))


def _encoded(encoder: Encoder, texts: pa.StringArray) -> pa.ListArray:
    ids, ends = array("i"), array("i", [0])
    for some in encoder.encode_all(texts.to_pylist()):
        ids.extend(some)
        ends.append(len(ids))
    return pa.ListArray.from_arrays(_ints(ends), _ints(ids))


def _ints(values: array) -> pa.Int32Array:
    return pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values)])


def _strung(table: pa.BinaryArray, ids: pa.ListArray) -> Iterator[memoryview]:
    """For each list, the entries of its ids one after the other: they lie so in the taken array."""
    taken = table.take(ids.values)
    _, ends, data = taken.buffers()
    ends = memoryview(ends).cast("b").cast("i")[: len(taken) + 1]
    data = memoryview(data) if data else memoryview(b"")
    places = memoryview(ids.buffers()[1]).cast("b").cast("i")
    for i in range(len(ids)):
        yield data[ends[places[i]] : ends[places[i + 1]]]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `ids` array<int>, one row per input row.

    NULL and empty texts give an empty array, NULL ids stay, repeated rows are encoded each, an empty table
    gives none. Other columns are not read. Texts of any length are encoded whole.
    """
    model = sentencepiece_model(ranks)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, pattern)
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_pylist()
            for part in _in_parts(lengths) if lengths else ():
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rows.column(0), _encoded(encoder, rows.column("text"))], names=[id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """`id_col` and `decoded` binary (with `keep_ids` also `ids`), from the ids alone; NULL ids give no bytes."""
    model = sentencepiece_model(ranks)
    rows = encoded.select(id_col, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(model)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()
            for part in _in_parts(sizes) if sizes else ():
                rows = batch.slice(part.start, part.stop - part.start)
                decoded = [b"".join(map(table.__getitem__, ids or ())) for ids in rows.column("ids").to_pylist()]
                columns = [rows.column(0), pa.array(decoded, pa.binary()), *([rows.column("ids")] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "decoded", *(["ids"] if keep_ids else [])])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, decoded binary" + ", ids array<int>" * keep_ids)


def encode_and_decode(
    docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`id_col`, `n_tokens`, `ids_sha256`, `decoded_sha256`, with `keep_ids` also `ids`: encode, decode the ids, digest both.

    NULL and empty texts have no ids and the digests of nothing; NULL ids and repeated rows stay; an empty table gives
    none. Other columns are not read. Texts of any length are encoded whole, in one pass of a task over its rows.
    """
    ranks = read_ranks(vocabulary)
    model = sentencepiece_model(ranks)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]

    def digests(parts: Iterator[memoryview]) -> pa.StringArray:
        return pa.array([hashlib.sha256(part).hexdigest() for part in parts], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, pattern)
        decoded = pa.array(decoding_table(model), pa.binary())
        decimal = pa.array([b" %d" % i for i in range(len(decoded))], pa.binary())
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_pylist()
            for part in _in_parts(lengths) if lengths else ():
                rows = batch.slice(part.start, part.stop - part.start)
                ids = _encoded(encoder, rows.column("text"))
                count = pc.list_value_length(ids).cast(pa.int64())
                columns = [rows.column(0), count, digests(p[1:] for p in _strung(decimal, ids)), digests(_strung(decoded, ids))]
                yield pa.RecordBatch.from_arrays([*columns, *([ids] if keep_ids else [])], names=names)

    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + ", ids array<int>" * keep_ids)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
