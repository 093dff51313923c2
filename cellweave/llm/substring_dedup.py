"""Exact removal of repeated passages by level-wise doubling.

A window of 2k words can only be repeated if the two windows of k words that make it up are. So windows of a short length
are looked up first; those found repeated, here or in any other batch, are extended to twice the length as candidates,
and so on up to the window length asked for. A batch stops at the level where none of its candidates survive. At the
last length, each window learns whether its words also start earlier.

Documents are dealt into batches. At each level a batch sends its distinct candidate hashes to hash buckets, packed, and
gets back which of them are repeated (at the last level: which start earlier elsewhere). All levels and the last pass use
the same shuffle of the texts. Levels before the last prune by 32 hash bits within a bucket, so a chance match there
costs a candidate and no more; the last level decides by 128 bits, two hashes of independent word hashes, within a batch
as between batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.batching import KEY, blobs, by_bucket, dealt, ids_of, in_order, packed, sizes, table_of, unpacked
from cellweave.llm.textblock import SPACED, TextBlock, Windows, covered, mix, per_text, running, spans_of

WINDOW = 20
_SENT = f"bucket int, {KEY} int, hashes binary, others binary, places binary, ids binary, ties binary, counts binary"
_ANSWER = f"{KEY} int, bucket int, found binary"
#: Seed of the second word hash.
_OTHER = 0x1E98DF25


def levels(window: int, start: int) -> list[int]:
    """start, 2 start, 4 start ... and the window; the last step may be shorter than a doubling."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class Batch:
    """A batch's words and window hashes."""

    def __init__(self, table: pa.Table):
        self.table = in_order(table)
        self.block = TextBlock(self.table.column("text"), SPACED)
        self.windows = Windows(self.block.word_hashes())
        self.room = self.block.room()

    def places(self, length: int) -> np.ndarray:
        return np.flatnonzero(self.room >= length)

    def hashes(self, length: int, places: np.ndarray) -> np.ndarray:
        return mix(self.windows.of(length)[places])

    def other_hashes(self, length: int, places: np.ndarray) -> np.ndarray:
        return mix(Windows(self.block.word_hashes(_OTHER)).of(length)[places])

    def cells(self, length: int, places: np.ndarray, buckets: int) -> np.ndarray:
        """(bucket << 32 | 32 hash bits) of windows, for the levels before the last."""
        h = self.hashes(length, places)
        return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))

    def repeated_at_first(self, length: int, buckets: int, answers: dict[int, list]) -> np.ndarray:
        places = self.places(length)
        known, which, n = np.unique(self.cells(length, places, buckets), return_inverse=True, return_counts=True)
        again = n > 1
        edges = np.searchsorted(known >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        for b, (bits,) in answers.items():
            a, z = edges[b], edges[b + 1]
            again[a:z] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(z - a)).astype(bool)
        mask = np.zeros(self.block.words, bool)
        mask[places[again[which]]] = True
        return mask

    def own_repeats(self, length: int, first_too: bool) -> np.ndarray:
        """Windows that the batch itself repeats; without the first of each unless ``first_too``."""
        places = self.places(length)
        h = self.hashes(length, places)
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = h[1:] == h[:-1]
        if same.any():
            # Those alike by one hash are compared by both.
            alike = np.append(False, same)
            alike[:-1] |= same
            few = order[alike]
            both = self.other_hashes(length, places[few])
            ranked = np.lexsort((few, both, h[alike]))
            order[alike], h, other = few[ranked], h, np.zeros(len(h), np.uint64)
            other[alike] = both[ranked]
            same &= other[1:] == other[:-1]
        again = np.append(False, same)
        if first_too:
            again[:-1] |= same
        mask = np.zeros(self.block.words, bool)
        mask[places[order[again[: len(order)]]]] = True
        return mask

    def repeated(self, steps: list[int], level: int, buckets: int, answers: dict[int, list]) -> np.ndarray:
        """Windows of ``steps[level]`` words that are repeated here or elsewhere, by the answers at that level."""
        if level == 0:
            return self.repeated_at_first(steps[0], buckets, answers)
        mask = self.own_repeats(steps[level], True)
        for found in answers.values():
            for x in found:
                mask[unpacked(x)] = True
        return mask


def _answers(table: pa.Table) -> dict[int, list]:
    out: dict[int, list] = {}
    for b, found in zip(table.column("bucket").to_pylist(), blobs(table.column("found"))):
        out.setdefault(b, []).append(found)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, start: int | None = None, text: str = "text", id: str = "doc_id", batches: int | None = None, buckets: int | None = None) -> DataFrame:
    """The columns of ``docs`` with n_words, n_removed, kept_text and removed_spans (word positions).

    A word ``[^\\x20\\x09-\\x0D]+`` is removed if a window of ``window`` consecutive words of its document covers it whose
    word sequence also starts earlier: in a document of smaller id, or earlier in the same one. Windows are judged on the
    input, not on what is left. kept_text: the other words joined by one space. A null or empty text has no words and an
    empty kept_text. Ids are whole numbers; null comes before all; rows that share an id are ordered by Spark's xxhash64 of
    their texts, so of two equal rows one keeps its words. Only rows equal in id and text are sure to share a task. New
    columns replace those of their names. start: the first level (a quarter of the window).
    """
    names = ["n_words", "n_removed", "kept_text", "removed_spans"]
    docs = docs.drop(*names)
    steps = levels(window, start or -(-window // 4))
    if len(steps) == 1:
        raise ValueError("the window must be longer than the start length")
    size = sizes(docs, text) if batches is None or buckets is None else None
    n_batches, n_buckets = batches or size.batches, buckets or size.buckets
    keyed = dealt(docs, n_batches, id, text)
    sent = keyed.groupBy(KEY).applyInArrow(_first_sender(steps, n_buckets), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_first_bucket, _ANSWER)
    for level in range(1, len(steps)):
        last = level == len(steps) - 1
        sent = keyed.groupBy(KEY).cogroup(answers.groupBy(KEY)).applyInArrow(_sender(steps, level, n_buckets, last), _SENT)
        answers = sent.groupBy("bucket").applyInArrow(_last_bucket if last else _middle_bucket, _ANSWER)
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    schema = T.StructType([*(keyed.schema[c] for c in ("row", "text")), *added])
    found = keyed.groupBy(KEY).cogroup(answers.groupBy(KEY)).applyInArrow(_remover(window), schema)
    return found.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns], *names)


def _first_sender(steps: list[int], buckets: int):
    def run(table: pa.Table) -> pa.Table:
        batch, key = Batch(table), table.column(KEY)[0].as_py()
        known = np.unique(batch.cells(steps[0], batch.places(steps[0]), buckets))
        return table_of(_of_cells(known, buckets, key), _SENT)

    return run


def _of_cells(cells: np.ndarray, buckets: int, key: int, places: np.ndarray | None = None) -> list[tuple]:
    """A row for each bucket of ascending cells, with the windows' places if they are given."""
    edges = np.searchsorted(cells >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    bits = (cells & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = [(int(b), slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges))]
    return [(b, key, packed(bits[s]), None, None if places is None else places[s].astype(np.uint32).tobytes(), None, None, None) for b, s in at]


def _first_bucket(table: pa.Table) -> pa.Table:
    """For each batch, a bit for each hash that it sent: some other batch sent it too."""
    parts = [unpacked(x).astype(np.uint32) for x in blobs(table.column("hashes"))]
    shared = _shared(parts)
    bucket = table.column("bucket")[0].as_py()
    rows = []
    for key, part in zip(table.column(KEY).to_pylist(), parts):
        found = _among(part, shared)
        if found.any():
            rows.append((key, bucket, np.packbits(found).tobytes()))
    return table_of(rows, _ANSWER)


def _shared(parts: list[np.ndarray]) -> np.ndarray:
    """Values of more than one of these ascending arrays."""
    whole = np.concatenate([p[np.append(True, p[1:] != p[:-1])[: len(p)]] for p in parts])
    whole.sort()
    return np.unique(whole[1:][whole[1:] == whole[:-1]])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the ascending ``known``: a search each, so that a batch's share of a bucket doesn't cost all of it."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _sender(steps: list[int], level: int, buckets: int, last: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of([], _SENT)
        batch, key = Batch(table), table.column(KEY)[0].as_py()
        length, shorter = steps[level], steps[level - 1]
        repeated = batch.repeated(steps, level - 1, buckets, _answers(answers))
        if not repeated.any():
            return table_of([], _SENT)
        candidates = batch.places(length)
        candidates = candidates[repeated[candidates] & repeated[candidates + length - shorter]]
        h = batch.hashes(length, candidates)
        if not last:
            h, at = np.unique(h, return_index=True)
            # Each distinct window keeps its place, also where its cell is another's too.
            cells = batch.cells(length, candidates[at], buckets)
            order = np.argsort(cells, kind="stable")
            return table_of(_of_cells(cells[order], buckets, key, candidates[at[order]]), _SENT)
        other = batch.other_hashes(length, candidates)
        order = np.lexsort((other, h))  # stable: of equal windows, the first place comes first
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])
        at = np.sort(order[new])
        h, other, at = h[at], other[at], candidates[at]
        text = np.searchsorted(batch.block.first, at, side="right") - 1
        ids, ties = ids_of(batch.table)[text], batch.table.column("tie").to_numpy()[text]
        rows = []
        for b, mine in by_bucket((mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64), buckets):
            own = text[mine]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            counts = np.diff(np.append(starts, len(own))).astype(np.uint32)
            rows.append((b, key, h[mine].tobytes(), other[mine].tobytes(), packed(at[mine]), ids[mine][starts].tobytes(), ties[mine][starts].tobytes(), counts.tobytes()))
        return table_of(rows, _SENT)

    return run


def _middle_bucket(table: pa.Table) -> pa.Table:
    """For each batch, the places of windows that other batches hold too."""
    parts = [unpacked(x).astype(np.uint32) for x in blobs(table.column("hashes"))]
    shared = _shared(parts)
    bucket = table.column("bucket")[0].as_py()
    rows = []
    for key, part, places in zip(table.column(KEY).to_pylist(), parts, blobs(table.column("places"))):
        found = _among(part, shared)
        if found.any():
            rows.append((key, bucket, packed(np.sort(np.frombuffer(places, np.uint32)[found]))))
    return table_of(rows, _ANSWER)


def _last_bucket(table: pa.Table) -> pa.Table:
    """For each batch, the places of windows that an earlier document of another batch holds too."""
    column = lambda name, kind: [np.frombuffer(x, kind) for x in blobs(table.column(name))]
    parts, counts = column("hashes", np.uint64), column("counts", np.uint32)
    whole, other = np.concatenate(parts), np.concatenate(column("others", np.uint64))
    ids = np.concatenate([np.repeat(x, n) for x, n in zip(column("ids", np.int64), counts)])
    ties = np.concatenate([np.repeat(x, n) for x, n in zip(column("ties", np.int64), counts)])
    order = np.lexsort((ties, ids, other, whole))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]) | (other[order][1:] != other[order][:-1])
    least = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.empty(len(order), bool)
    later[order] = (ids[order] != ids[least]) | (ties[order] != ties[least])
    edges = np.append(0, np.cumsum([len(p) for p in parts]))
    bucket = table.column("bucket")[0].as_py()
    rows = []
    for k, (key, places) in enumerate(zip(table.column(KEY).to_pylist(), blobs(table.column("places")))):
        mine = later[edges[k] : edges[k + 1]]
        if mine.any():
            rows.append((key, bucket, packed(unpacked(places)[mine])))
    return table_of(rows, _ANSWER)


def _remover(window: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table)
        block = batch.block
        later = batch.own_repeats(window, False)
        for found in blobs(answers.column("found")):
            later[unpacked(found)] = True
        gone = covered(np.flatnonzero(later), window, block.words)
        starts, ends, at = spans_of(gone, block.first)
        base = np.repeat(block.first[:-1], np.diff(at))
        spans = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], names=["start", "end"]))
        new = [pa.array(block.counts, pa.int64()), pa.array(per_text(gone, block.first)), kept_text(block, ~gone), spans]
        return pa.table([batch.table.column("row"), batch.table.column("text"), *new], names=["row", "text", "n_words", "n_removed", "kept_text", "removed_spans"])

    return run


def kept_text(block: TextBlock, kept: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    words = np.flatnonzero(kept)
    owner = np.searchsorted(block.first, words, side="right") - 1
    steps = np.zeros(len(block.data) + 1, np.int8)
    steps[block.starts[words]] = 1
    steps[block.ends[words]] -= 1  # where the next text begins at once, both meet
    mask = np.cumsum(steps[:-1], dtype=np.int8) > 0
    joints = block.ends[words[:-1][owner[1:] == owner[:-1]]] if len(words) else words
    data = block.data.copy()
    data[joints], mask[joints] = 0x20, True
    at = running(mask)[block.at]
    return pa.StringArray.from_buffers(block.n, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data[mask].tobytes()))
