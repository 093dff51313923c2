"""A batch of texts as one byte buffer, with its words found, hashed and windowed by numpy.

Tasks receive texts as Arrow columns. A ``TextBlock`` works on the column's own buffer, so no Python string is
made for a word. Word separators are ASCII in every rule used here, so bytes and code points split alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Words of ``[^\x20\x09-\x0D]+``: every byte but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and all that is not ASCII (A-Z too, as texts are lower-cased).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LENGTH, _BLOCK, _ORDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed by BLAKE2, a call each; shorter ones by blocks of eight bytes, all spans at once.
_LONG = 512
_CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashed(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of spans of a buffer that is eight bytes longer than its text."""
    blocks = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))  # the eight bytes from each position on
    size = ends - starts
    found = mix(size.astype(np.uint64) * _LENGTH + np.uint64(seed))
    for k in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(buffer[starts[k] : ends[k]], digest_size=8, key=seed.to_bytes(8, "little")).digest()
        found[k] = int.from_bytes(digest, "little")
    places = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = starts[places], size[places]
    while len(places):
        block = blocks[at]
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        found[places] = mix((found[places] ^ block) * _BLOCK)
        more = left > 8
        places, at, left = places[more], at[more] + 8, left[more] - 8
    return found


def slices(batches, column: str, limit: int = 4 << 20):
    """Arrow record batches cut where their texts pass ``limit`` bytes, so that a task's memory follows neither rows nor text length."""
    for batch in batches:
        _, at = string_buffer(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + limit, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def string_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets) of an Arrow string column; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


class TextBlock:
    """Texts of a batch: ``data``, ``at`` (n+1 byte offsets), words by ``starts``/``ends``, ``first`` (n+1 word offsets)."""

    def __init__(self, column, word: np.ndarray = SPACED, lower: bool = False):
        self.data, self.at = string_buffer(column)
        self.n = len(self.at) - 1
        self.lower = lower
        inside = word[self.data]
        size = len(inside)
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        if size:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = self.at[:-1]
            before[edges[edges < size]] = False
            edges = self.at[1:]
            after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.words = len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes (lower-cased A-Z if ``lower``)."""
        return self.span_hashes(self.starts, self.ends, seed)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each span's bytes; other seeds give independent ones. Spans are in order and don't overlap.

        A span's blocks of eight bytes are mixed in one after the other, each by a bijection that isn't linear, so that no
        arrangement of words or letters collides by construction, as it does in a polynomial modulo 2^64.
        """
        out = np.empty(len(starts), np.uint64)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + _CHUNK)))
            low, high = int(starts[a]), int(ends[b - 1])
            buffer = np.zeros(high - low + 8, np.uint8)
            buffer[:-8] = _LOWER[self.data[low:high]] if self.lower else self.data[low:high]
            out[a:b] = _hashed(buffer, starts[a:b] - low, ends[a:b] - low, seed)
            a = b
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, n+1 line offsets) of the \\n-split lines that hold a word."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.unique(np.concatenate([self.at[:-1], breaks + 1]))
        starts = starts[starts < len(self.data)]
        ends = np.append(starts[1:], len(self.data))[: len(starts)]
        ends = ends - (self.data[ends - 1] == 0x0A)
        held = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[held], ends[held]
        return starts, ends, np.searchsorted(starts, self.at)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(self.words)


class Windows:
    """Hashes of word windows by doubling: a window of 2k is made of two of k. Other word hashes give independent ones."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def of(self, length: int) -> np.ndarray:
        """Hash of the window that starts at each word (meaningless where it runs beyond the end). Nothing is remembered."""
        if length == 1:
            return self.words
        half = length // 2
        left = self.of(length - half)
        right = left if half == length - half else self.of(half)
        out = left * _ORDER
        out[: max(0, len(right) - (length - half))] += right[length - half :]
        return mix(out)


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """True for positions that a window of this length, beginning at one of ``starts``, covers."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.subtract.at(step, np.minimum(starts + length, size), 1)
    return np.cumsum(step[:size], dtype=np.int32) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per word) for each text, exact for whole numbers."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def by_owner(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys that are equal only where both the key and the owning text are."""
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    return mix(keys + mix(owner + np.uint64(1)))


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading 0: sums over ``[a, b)`` are differences."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def spans_of(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True within texts: (starts, ends, n+1 offsets of runs), in positions of the whole batch."""
    before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    if len(mask):
        before[1:], after[:-1] = mask[:-1], mask[1:]
        edges = first[:-1]
        before[edges[edges < len(mask)]] = False
        edges = first[1:]
        after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, first)
