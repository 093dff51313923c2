"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Every vocabulary entry becomes a piece: its bytes mapped to 256 visible characters, its score the negative rank.
Sentencepiece's BPE joins the adjacent pair whose joined piece scores highest, leftmost first, which is the
lowest-rank merge of the rank file. Normalisation is the identity, with no dummy prefix and no white space rules.

Text is first cut by the vocabulary's pattern. Cuts never depend on what lies beyond a space that follows a
character other than white space, so the text is divided there and each distinct division is encoded once a worker
(a cache bounded in entries and their length); repeated words then cost one look-up. That rule is the shipped pattern's; a
text of any other pattern is one division.

Decoding is the inverse mapping: the pieces' characters, put together, are looked up as bytes.
"""

from __future__ import annotations

import base64
import functools
import gc
import re
import struct
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellweave.llm.textblock import slices

#: Divisions remembered by a worker, beyond which the memory starts anew, and characters of the longest one remembered.
#: Results don't depend on it.
CACHE_ENTRIES, CACHE_LENGTH = 150_000, 64
_LATE_SPACE = re.compile(r"\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A visible character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: a length-delimited one, a 32-bit float or a varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto. Piece 0 is the unknown piece; the entry with the k-th lowest rank is piece k+1."""
    shown = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, "".encode()) + _field(2, 0.0) + _field(3, unknown)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, "".join(shown[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal))
    trainer = _field(3, bpe) + _field(4, len(pieces))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to ids and ids back to bytes, as the rank file and pattern prescribe."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.rank_of_piece = [-1, *sorted(ranks.values())]
        self.whole = {t.decode(): (r,) for t, r in ranks.items() if _is_text(t)}
        self.cut = regex.compile(pattern).findall
        self.divide = divisions if pattern == public_tokenizers.PATTERN else lambda text: [text] if text else []
        characters = byte_characters()
        self.shown = dict(enumerate(characters))
        self.piece_of = {r: self.pieces.id_to_piece(k) for k, r in enumerate(self.rank_of_piece) if k}
        self.byte_of = np.zeros(0x200, np.uint8)
        self.byte_of[[ord(c) for c in characters]] = np.arange(256)
        self.space = self.shown[0x20]
        self.known: dict[str, tuple[int, ...]] = {}

    def _mapped(self, part: str) -> str:
        if part.isascii() and part[1:].isalpha():
            return self.space + part[1:] if part[0] == " " else part.encode().decode("latin-1").translate(self.shown)
        return part.encode().decode("latin-1").translate(self.shown)

    def _learn(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of divisions that no cache has: cut, looked up whole, and merged by the model where that fails."""
        cuts = list(map(self.cut, new))
        ids = dict.fromkeys(chain.from_iterable(cuts))
        ids.update((x, self.whole[x]) for x in ids.keys() & self.whole.keys())
        merged = [x for x, found in ids.items() if found is None]
        rank = self.rank_of_piece.__getitem__
        ids.update(zip(merged, (tuple(map(rank, found)) for found in self.pieces.encode(list(map(self._mapped, merged)), num_threads=1))))
        return {x: ids[parts[0]] if len(parts) == 1 else sum(map(ids.__getitem__, parts), ()) if len(parts) < 9 else tuple(chain.from_iterable(map(ids.__getitem__, parts))) for x, parts in zip(new, cuts)}

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        rows = list(map(self.divide, texts))
        needed = set(chain.from_iterable(rows))
        if len(self.known) > CACHE_ENTRIES:
            self.known = {x: self.known[x] for x in needed if x in self.known}
        new = self._learn(list(needed.difference(self.known)))
        self.known.update(new)
        ids = self.known.__getitem__
        found = [list(chain.from_iterable(map(ids, row))) for row in rows]
        for x in new:
            if len(x) > CACHE_LENGTH:
                del self.known[x]
        return found

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode_all(self, rows: list) -> pa.Array:
        """The bytes that each row of ids stands for; an id outside the vocabulary is an error (KeyError)."""
        pieces = ["".join(map(self.piece_of.__getitem__, row)) for row in rows]
        characters = np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)
        at = np.append(0, np.cumsum(list(map(len, pieces)))).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(self.byte_of[characters].tobytes())])

    def decode(self, ids) -> bytes:
        return self.decode_all([ids])[0].as_py()


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def divisions(text: str) -> list[str]:
    """Parts of a text that are cut alike alone: each begins at the text's start or at a space after other than white space."""
    parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _split_at_spaces(text)
    if parts[0] and not _LATE_SPACE.search(text):
        return parts
    joined = [parts[0]]
    for x in parts[1:]:
        if joined[-1] and not joined[-1][-1].isspace():
            joined.append(x)
        else:
            joined[-1] += x
    return [x for x in joined if x]


def _split_at_spaces(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file that every node can read."""
    return Codec(read_ranks(path), pattern)


def _appended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    clash = {f.name.lower() for f in fields} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return T.StructType([*df.schema.fields, *fields])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns, with the ids of each whole text, and the bytes decoded from these ids if ``decoded`` names a column.

    A null or empty text has no ids. The rank file's path must be readable on every node. Rows, order within a
    partition and other columns stay as they are; a name that exists already raises ValueError.
    """
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    schema = _appended(df, *fields)

    def encoded(batch):
        found = codec(path, pattern).encode_all([x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()])
        at = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=at[1:])
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(at[-1]))
        new = [pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
        if decoded:
            new.append(codec(path, pattern).decode_all(found))
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    def run(batches):
        for batch in slices(batches, text):
            gc.disable()  # lists of ids make no cycles; looking for some takes a third of the time
            try:
                out = encoded(batch)
            finally:
                gc.enable()
            yield out

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns, with the bytes that an array of ids stands for (a null array: null); an unknown id fails the job."""
    schema = _appended(df, T.StructField(decoded, T.BinaryType()))

    def run(batches):
        tool = codec(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            new = tool.decode_all([x or [] for x in column.to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(column.is_null(), None, new)], names=schema.names)

    return df.mapInArrow(run, schema)
