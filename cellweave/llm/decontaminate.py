"""Benchmark decontamination by Wu-Manber search, with words as the alphabet.

Every window of ``window`` consecutive benchmark words (a whole item, if it is shorter) is a search pattern.
Patterns of one length L are searched together: a table gives, for each block of B words, how far the search may
move on because no pattern can end there; where it gives 0, the bucket of the patterns with that suffix block is scanned:
of those that begin with the text's first word, each is compared word by word. All texts of a batch are searched at once,
in lanes that step in parallel. Words are compared by 64-bit hashes first; what then agrees is compared by its bytes.

A pattern is a place in the items' words, so the words are held once, however many patterns overlap there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.durable import saved
from cellweave.llm.textblock import ALNUM, TextBlock, covered, mix, per_text, slices, spans_of

WINDOW = 13
#: Benchmark bytes in one search: a worker holds some five to six times as much. A larger benchmark is searched in several
#: blocks, one after the other.
BLOCK_BYTES = 64 << 20
_LANE = 512
_BLOCK = 2
_FACTOR = np.uint64(0xA0761D6478BD642F)


class Patterns:
    """Patterns of one length over the items' word hashes: shift table and suffix buckets."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, length: int):
        self.length, self.words = length, words
        self.block = min(_BLOCK, length)
        self.bits = np.uint64(64 - max(12, int(len(starts)).bit_length() + 2))
        self.shift = np.full(1 << int(64 - self.bits), length - self.block + 1, np.uint8 if length < 255 else np.int64)
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, self._cells(words, starts + (end - 1)), length - end)
        keys = self._keys(words, starts)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = keys[order], starts[order].astype(np.uint32 if len(words) < 1 << 32 else np.int64)

    def _cells(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Cells of the shift table for the blocks of words that end at these places."""
        out = words[last]
        for k in range(1, self.block):
            out = words[last - k] * _FACTOR + out
        return (mix(out.copy()) >> self.bits).astype(np.int64)

    def _keys(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The suffix block's cell in front (the bucket), then bits of the first word's hash (the order within the bucket)."""
        cell = self._cells(words, starts + (self.length - 1)).astype(np.uint64)
        return cell << self.bits | mix(words[starts]) >> np.uint64(64 - int(self.bits))

    def search(self, words: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words of the occurrences, places of the patterns among the items' words), each text word and pattern once.

        room: words from each one to its text's end.
        """
        at = np.arange(self.length - 1, len(words), _LANE)
        stops = np.minimum(at + _LANE, len(words))
        stopped: list[np.ndarray] = []
        while len(at):
            move = self.shift[self._cells(words, at)]
            stopped.append(at[move == 0])
            at = at + np.maximum(move, 1)
            on = at < stops
            at, stops = at[on], stops[on]
        starts = np.concatenate(stopped) - self.length + 1 if stopped else np.zeros(0, np.int64)
        starts = np.sort(starts[room[starts] >= self.length])
        keys = self._keys(words, starts)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        scan = np.flatnonzero(low < high)
        while len(scan):  # one more pattern of each bucket at a turn
            here, pattern = starts[scan], self.starts[low[scan]].astype(np.int64)
            same = np.ones(len(scan), bool)
            for k in range(self.length):
                same[same] = words[here[same] + k] == self.words[pattern[same] + k]
            found.append((here[same], pattern[same]))
            low[scan] += 1
            scan = scan[low[scan] < high[scan]]
        if not found:
            return starts[:0], starts[:0]
        return np.concatenate([h for h, _ in found]), np.concatenate([p for _, p in found])


class Search:
    """All windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        block = TextBlock(pa.array([text for _, text in items], pa.string()), ALNUM, lower=True)
        self.words, self.first = block.word_hashes(), block.first
        self.owners = np.array([number[name] for name, _ in items], np.int64)
        self.bytes, self.begins, self.ends = lowered(block.data), block.starts.astype(np.int32), block.ends.astype(np.int32)
        length = np.minimum(np.repeat(block.counts, block.counts), window)
        fits = block.room() >= length
        self.classes = [Patterns(self.words, np.flatnonzero(fits & (length == n)), int(n)) for n in np.unique(length[fits])]

    def _same_bytes(self, data: np.ndarray, block: TextBlock, here: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Whether words of a text and of the items, equal in hash, are equal in bytes."""
        pairs, which = np.unique(np.stack([here, there]), axis=1, return_inverse=True)
        size = block.ends[pairs[0]] - block.starts[pairs[0]]
        same = size == self.ends[pairs[1]] - self.begins[pairs[1]]
        size = np.where(same, size, 0)
        pair = np.repeat(np.arange(len(size)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = data[block.starts[pairs[0]][pair] + inside] != self.bytes[self.begins[pairs[1]][pair] + inside]
        same[pair[differ]] = False
        return same[which.ravel()]

    def hits(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mask of words hit, text numbers, item numbers): a text and item for each item with an occurrence."""
        hashes, room, data = block.word_hashes(), block.room(), None
        mask, texts, items = np.zeros(block.words, bool), [], []
        for patterns in self.classes:
            starts, places = patterns.search(hashes, room)
            if len(starts):
                data = lowered(block.data) if data is None else data
                steps = np.arange(patterns.length)
                same = self._same_bytes(data, block, (starts[:, None] + steps).ravel(), (places[:, None] + steps).ravel()).reshape(-1, patterns.length).all(1)
                starts, places = starts[same], places[same]
                mask |= covered(starts, patterns.length, block.words)
                pairs = np.unique(np.stack([np.searchsorted(block.first, starts, side="right") - 1, self.owners[np.searchsorted(self.first, places, side="right") - 1]]), axis=1)
                texts.append(pairs[0])
                items.append(pairs[1])
        if not texts:
            return mask, np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(texts), np.concatenate(items)]), axis=1)
        return mask, pairs[0], pairs[1]


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", SPAN), T.StructField("hit_items", T.ArrayType(T.StringType()))]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs`` with n_words, n_hit, hit_spans (word positions) and hit_items (sorted as strings).

    Words are maximal runs of digits, letters and all characters beyond ASCII, with A-Z lower-cased. A null or empty
    text has no words; a benchmark item without words has no windows; items that share an id count as one; a null id
    is named ``null``. Repeated rows are judged alike. The result columns replace any of the same names. Documents
    aren't shuffled: they are searched where they are read, once for each ``block_bytes`` of benchmark text. Blocks follow
    one after the other, each written before the next one is read, so the driver and a task hold one at a time.
    """
    names = [f.name for f in FOUND]
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *FOUND])
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.col(item_text).alias("words")).where("words is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("words") + 16), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    out = docs
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("name", "words"), F.lit(n_blocks)) == k)
        search = Search([(r.name, r.words) for r in part.toLocalIterator()], window)
        out = out.mapInArrow(_searcher(search, text, schema, earlier=k > 0), schema)
        if k + 1 < n_blocks:
            out = saved(out)
    return out


def _searcher(search: Search, text: str, schema: T.StructType, earlier: bool):
    """A task's function; earlier: its input holds what other blocks have found, to which it adds."""
    names, new = schema.names, len(FOUND)

    def run(batches):
        for batch in slices(batches, text):
            block = TextBlock(batch.column(batch.schema.get_field_index(text)), ALNUM, lower=True)
            mask, texts, items = search.hits(block)
            labels = [search.names[i] for i in items]
            if earlier:
                mask, texts, labels = _joined(batch, block, mask, texts, labels)
            starts, ends, at = spans_of(mask, block.first)
            base = np.repeat(block.first[:-1], np.diff(at))
            order = sorted(range(len(labels)), key=lambda i: (texts[i], labels[i]))
            item_at = np.searchsorted(np.sort(texts), np.arange(block.n + 1))
            spans = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], names=["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names) - new],
                    pa.array(block.counts, pa.int64()),
                    pa.array(per_text(mask, block.first)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans),
                    pa.ListArray.from_arrays(pa.array(item_at.astype(np.int32)), pa.array([labels[i] for i in order], pa.string())),
                ],
                names=names,
            )

    return run


def _joined(batch, block, mask, texts, labels):
    known = {(int(t), label) for t, label in zip(texts, labels)}
    for k, (spans, items) in enumerate(zip(batch.column(batch.schema.get_field_index("hit_spans")).to_pylist(), batch.column(batch.schema.get_field_index("hit_items")).to_pylist())):
        for x in spans:
            mask[block.first[k] + x["start"] : block.first[k] + x["end"]] = True
        known |= {(k, label) for label in items}
    pairs = sorted(known)
    return mask, np.array([t for t, _ in pairs], np.int64), [label for _, label in pairs]
