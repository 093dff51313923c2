"""Removal of lines that many documents hold, with two Bloom filters before any line is shuffled.

Documents are dealt into batches. A batch sends each hash bucket the distinct hashes of its lines, packed. A bucket goes
through them with two Bloom filters, one of hashes seen once and one of those seen again, and tells each batch which of its
hashes are in the second: these are the suspected repeats. Only suspects are shuffled as lines, one row for each that a
batch holds, however often; their documents are counted by the lines themselves, so a chance match of hashes or filters
costs a row and nothing else. Lines confirmed go back to the batches that hold them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.batching import KEY, blobs, dealt, packed, sizes, table_of, unpacked
from cellweave.llm.textblock import SPACED, TextBlock, lowered, mix, running

MIN_CHARS = 40
MIN_DOCUMENTS = 5
#: Bits of a filter for each hash that it may take, and probes of each: about one false suspect in 400.
FILTER_BITS, PROBES = 16, 5
_SENT = f"bucket int, {KEY} int, hashes binary, twice binary"
_ANSWER = f"{KEY} int, bucket int, found binary"
_SUSPECT = f"line string, {KEY} int, documents long, last long"


class Bloom:
    """A Bloom filter of 64-bit hashes; bits are a power of two."""

    def __init__(self, entries: int):
        self.mask = np.uint64((1 << max(10, (FILTER_BITS * max(1, entries) - 1).bit_length())) - 1)
        self.bits = np.zeros((int(self.mask) + 1) >> 3, np.uint8)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        step = mix(hashes) | np.uint64(1)
        return np.stack([(hashes + np.uint64(k) * step) & self.mask for k in range(PROBES)])

    def add(self, hashes: np.ndarray) -> None:
        at = self._places(hashes).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self._places(hashes)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)


class Lines:
    """All \\n-split lines of a batch's texts: ``starts``/``ends``, ``first`` (n+1 line offsets), and the span of each key."""

    def __init__(self, column):
        self.block = block = TextBlock(column, SPACED)
        breaks = np.flatnonzero(block.data == 0x0A)
        self.first = running(1 + np.diff(np.searchsorted(breaks, block.at)))
        total = self.first[-1]
        own = np.zeros(total, bool)
        own[self.first[:-1]] = True
        self.starts, self.ends = np.empty(total, np.int64), np.empty(total, np.int64)
        self.starts[own], self.starts[~own] = block.at[:-1], breaks + 1
        own[:] = False
        own[self.first[1:] - 1] = True
        self.ends[own], self.ends[~own] = block.at[1:], breaks

    def keys(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, start, end) of the keys of at least so many code points."""
        block = self.block
        a, b = np.searchsorted(block.starts, self.starts), np.searchsorted(block.starts, self.ends)
        line = np.flatnonzero(b > a)
        start, end = block.starts[a[line]], block.ends[b[line] - 1]
        heads = running((block.data & 0xC0) != 0x80)
        long = heads[end] - heads[start] >= least
        return line[long], start[long], end[long]

    def texts(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The keys of these spans, A-Z lower-cased."""
        mask = np.zeros(len(self.block.data) + 1, np.int8)
        np.add.at(mask, start, 1)
        np.add.at(mask, end, -1)
        data = lowered(self.block.data[np.cumsum(mask[:-1], dtype=np.int8) > 0])
        at = running(end - start)
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes()))

    def without(self, dropped: np.ndarray) -> pa.Array:
        """Each text's other lines, joined by \\n."""
        kept = ~dropped
        order = running(kept)
        joined = kept & (order[:-1] > np.repeat(order[self.first[:-1]], np.diff(self.first)))  # an earlier line of the text is kept
        steps = np.zeros(len(self.block.data) + 1, np.int8)
        np.add.at(steps, self.starts[kept], 1)
        np.add.at(steps, self.ends[kept], -1)
        mask = np.cumsum(steps[:-1], dtype=np.int8) > 0
        mask[self.starts[joined] - 1] = True
        at = running(mask)[self.block.at]
        return pa.StringArray.from_buffers(self.block.n, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(self.block.data[mask].tobytes()))


def drop_repeated_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, batches: int | None = None, buckets: int | None = None) -> DataFrame:
    """The columns of ``docs`` with n_lines, n_dropped, kept_text and dropped_lines (numbers from 0).

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. All lines of a key of at least
    ``min_chars`` code points (at least 1) that at least ``min_documents`` (2 or more) documents hold go, but for those of the largest id
    that holds it. Every row counts as a document, also those that share an id; rows of the largest id all keep their
    lines; null ids come before all. kept_text: the other lines, unchanged, joined by \\n. A null or empty text is one empty
    line. New columns replace those of their names. An empty table gives an empty one.
    """
    if min_chars < 1 or min_documents < 2:
        raise ValueError("keys must have a character and two documents")
    names = ["n_lines", "n_dropped", "kept_text", "dropped_lines"]
    docs = docs.drop(*names)
    size = sizes(docs, text) if batches is None or buckets is None else None
    n_batches, n_buckets = batches or size.batches, buckets or size.buckets
    keyed = dealt(docs, n_batches, id, text)
    sent = keyed.groupBy(KEY).applyInArrow(_sender(min_chars, n_buckets), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_bucket, _ANSWER)
    suspects = keyed.groupBy(KEY).cogroup(answers.groupBy(KEY)).applyInArrow(_suspects(min_chars, n_buckets), _SUSPECT)
    # A row a batch at most: even a line of a third of all documents makes a small group here, and its batches a short list.
    confirmed = suspects.groupBy("line").agg(F.sum("documents").alias("documents"), F.max("last").alias("last"), F.collect_list(KEY).alias("held_by"))
    confirmed = confirmed.where(F.col("documents") >= min_documents).select(F.explode("held_by").alias(KEY), "line", "last")
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("dropped_lines", T.ArrayType(T.LongType()))]
    schema = T.StructType([*(keyed.schema[c] for c in ("row", "text")), *added])
    found = keyed.groupBy(KEY).cogroup(confirmed.groupBy(KEY)).applyInArrow(_remover(min_chars), schema)
    return found.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns], *names)


def _hashes(lines: Lines, min_chars: int) -> tuple[np.ndarray, ...]:
    """(hash, line, start, end) of the keys. Hashes only name suspects."""
    line, start, end = lines.keys(min_chars)
    block = lines.block
    block.lower = True
    return block.span_hashes(start, end), line, start, end


def _cells(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """(bucket << 32 | 32 hash bits)."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def _sender(min_chars: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        lines, key = Lines(table.column("text")), table.column(KEY)[0].as_py()
        found, line, _, _ = _hashes(lines, min_chars)
        cells = _cells(found, buckets)
        owner = np.searchsorted(lines.first, line, side="right") - 1
        order = np.lexsort((owner, cells))
        cells, owner = cells[order], owner[order]
        fresh = np.ones(len(cells), bool)
        fresh[1:] = (cells[1:] != cells[:-1]) | (owner[1:] != owner[:-1])
        known, n = np.unique(cells[fresh], return_counts=True)  # documents of the batch, not lines
        edges = np.searchsorted(known >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        bits = (known & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = [(int(b), slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges))]
        return table_of([(b, key, packed(bits[s]), np.packbits(n[s] > 1).tobytes()) for b, s in at], _SENT)

    return run


def _bucket(table: pa.Table) -> pa.Table:
    """For each batch, a bit for each hash that it sent: the second filter holds it."""
    parts = [mix(unpacked(x).astype(np.uint64)) for x in blobs(table.column("hashes"))]
    total = sum(map(len, parts))
    once, again = Bloom(total), Bloom(total)
    for part, twice in zip(parts, blobs(table.column("twice"))):
        seen = once.holds(part) | np.unpackbits(np.frombuffer(twice, np.uint8), count=len(part)).astype(bool)
        again.add(part[seen])
        once.add(part)
    bucket = table.column("bucket")[0].as_py()
    rows = []
    for key, part in zip(table.column(KEY).to_pylist(), parts):
        found = again.holds(part)
        if found.any():
            rows.append((key, bucket, np.packbits(found).tobytes()))
    return table_of(rows, _ANSWER)


def _suspects(min_chars: int, buckets: int):
    schema = pa.schema([("line", pa.string()), (KEY, pa.int32()), ("documents", pa.int64()), ("last", pa.int64())])

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return schema.empty_table()
        lines, key = Lines(table.column("text")), table.column(KEY)[0].as_py()
        found, line, start, end = _hashes(lines, min_chars)
        cells = _cells(found, buckets)
        known = np.unique(cells)
        edges = np.searchsorted(known >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        suspect = np.zeros(len(known), bool)
        for b, bits in zip(answers.column("bucket").to_pylist(), blobs(answers.column("found"))):
            a, z = edges[b], edges[b + 1]
            suspect[a:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(z - a)).astype(bool)
        chosen = suspect[np.searchsorted(known, cells)]
        owner = np.searchsorted(lines.first, line[chosen], side="right") - 1
        coded = lines.texts(start[chosen], end[chosen]).dictionary_encode()
        held = pa.table({"line": coded.indices, "owner": owner})
        held = held.group_by(["line", "owner"]).aggregate([])
        held = pa.table({"line": held.column("line"), "id": table.column("id").take(held.column("owner"))})
        n = held.group_by("line").aggregate([([], "count_all"), ("id", "max")])
        return pa.Table.from_arrays([coded.dictionary.take(pa.concat_arrays(n.column("line").chunks)).cast(pa.string()), pa.array(np.full(n.num_rows, key, np.int32)), n.column("count_all"), n.column("id_max")], schema=schema)

    return run


def _remover(min_chars: int):
    def run(table: pa.Table, confirmed: pa.Table) -> pa.Table:
        lines = Lines(table.column("text"))
        dropped = np.zeros(lines.first[-1], bool)
        if table.num_rows and confirmed.num_rows:
            found, line, start, end = _hashes(lines, min_chars)
            wanted = pa.concat_arrays(confirmed.column("line").cast(pa.large_string()).chunks)
            block = TextBlock(wanted)
            some = np.flatnonzero(np.isin(found, block.span_hashes(block.at[:-1], block.at[1:])))
            which = pc.index_in(lines.texts(start[some], end[some]), wanted)
            some, which = some[which.is_valid().to_numpy(zero_copy_only=False)], which.drop_null()
            owner = np.searchsorted(lines.first, line[some], side="right") - 1
            mine, last = table.column("id").take(pa.array(owner)), confirmed.column("last").take(which)
            largest = pc.or_(pc.fill_null(pc.equal(mine, last), False), pc.and_(mine.is_null(), last.is_null()))
            dropped[line[some[~largest.to_numpy()]]] = True
        gone = np.flatnonzero(dropped)
        at = np.searchsorted(gone, lines.first)
        number = gone - np.repeat(lines.first[:-1], np.diff(at))
        new = [pa.array(np.diff(lines.first)), pa.array(np.diff(at)), lines.without(dropped), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(number))]
        return pa.table([table.column("row"), table.column("text"), *new], names=["row", "text", "n_lines", "n_dropped", "kept_text", "dropped_lines"])

    return run
