"""Quality rules: counts that simple rules use, and an isolation forest over them.

The forest is fitted on the statistics of documents labelled good: random splits of small samples, in which an odd
document is alone after few splits. Its path length, averaged over the trees, becomes an anomaly score; the score
beyond which a document is refused is calibrated on all labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.sampling import bounded
from cellweave.llm.textblock import SPACED, TextBlock, Windows, by_owner, covered, mix, running, slices

#: Rows that the forest sees at most (those whose ids' hashes are the least); trees and rows a tree.
SAMPLE = 4096
TREES = 100
ROWS_PER_TREE = 256
#: Among thresholds, a good document refused weighs so many times a bad one kept.
GOOD_WEIGHT = 3.0
BINS = 1000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_digits"]
STATS = [T.StructField(c, T.LongType()) for c in COUNTS]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def counts(block: TextBlock) -> list[np.ndarray]:
    """The statistics of ``COUNTS`` for each text of a block."""
    inside = SPACED[block.data]
    heads = running(inside & ((block.data & 0xC0) != 0x80))
    at = block.at
    sums = [x[at[1:]] - x[at[:-1]] for x in (running(table[block.data]) for table in (_SYMBOL, _UPPER, np.arange(256) == 0x21, _DIGIT))]
    starts, ends, first_line = block.lines()
    keys = by_owner(block.span_hashes(starts, ends), first_line)
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    lines = running(again)
    triples = by_owner(Windows(block.word_hashes()).of(3), block.first)
    fits = np.flatnonzero(block.room() >= 3)
    _, which, n = np.unique(triples[fits], return_inverse=True, return_counts=True)
    repeated = running(covered(fits[n[which] > 1], 3, block.words))
    return [block.counts, heads[at[1:]] - heads[at[:-1]], sums[0], lines[first_line[1:]] - lines[first_line[:-1]], repeated[block.first[1:]] - repeated[block.first[:-1]], *sums[1:]]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns with the counts of each whole text, where they are read (no shuffle). Columns of their names are replaced.

    n_words: words of ``[^\\x20\\x09-\\x0D]+``. word_chars: code points in words. n_symbols: characters of ``#*$%&|<>``.
    n_dup_lines: lines with a word that equal an earlier line of the text. n_repeat_words: words in three-word windows
    that occur twice or more in the text. n_upper, n_exclaim, n_digits: A-Z, ``!``, 0-9. A null or empty text: all 0.
    """
    docs = docs.drop(*COUNTS)
    schema = T.StructType([*docs.schema.fields, *STATS])

    def run(batches):
        for batch in slices(batches, text):
            found = counts(TextBlock(batch.column(batch.schema.get_field_index(text)), SPACED))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.int64)) for x in found)], names=schema.names)

    return docs.mapInArrow(run, schema)


def base_failed():
    """Too few words, or more than half of them repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def shares(x: np.ndarray) -> np.ndarray:
    """What the forest splits on: shares that don't follow a text's length (columns of COUNTS in)."""
    n_words, chars, symbols, dup_lines, repeated, upper, exclaim, digits = (x[:, k].astype(float) for k in range(len(COUNTS)))
    words = np.maximum(n_words, 1)
    return np.stack([np.minimum(chars / words, 40), symbols / words, np.minimum(dup_lines * 20 / words, 3), repeated / words, upper / np.maximum(chars, 1), exclaim / words, digits / words], axis=1)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as arrays: node -> split column, split value, children; a leaf's value is its path length."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = ROWS_PER_TREE, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.low, self.high = x.min(0), x.max(0)
        self.margin = 0.05 * np.maximum(self.high - self.low, 1e-3)
        self.trees = [self._tree(x[rng.choice(len(x), self.rows, replace=False)], rng) for _ in range(trees)]

    def _tree(self, x: np.ndarray, rng) -> list[np.ndarray]:
        limit = int(np.ceil(np.log2(max(2, self.rows))))
        column, value, left, right, length = [], [], [], [], []

        def grow(part: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            k = len(column)
            for store, start in ((column, -1), (value, 0.0), (left, k), (right, k), (length, depth + _expected(len(part)))):
                store.append(start)
            if depth < limit and len(part) > 1:
                c = int(rng.integers(x.shape[1]))
                # Splits fall anywhere in the node's own box, which reaches beyond the rows: outside is alone soon.
                v = rng.uniform(low[c], high[c])
                go = part[:, c] < v
                upper, lower = high.copy(), low.copy()
                upper[c], lower[c] = v, v
                column[k], value[k] = c, v
                left[k] = grow(part[go], low, upper, depth + 1)
                right[k] = grow(part[~go], lower, high, depth + 1)
            return k

        spread = np.maximum(x.max(0) - x.min(0), 2 * self.margin)
        grow(x, x.min(0) - spread / 2, x.max(0) + spread / 2, 0)
        return [np.array(a) for a in (column, value, left, right, length)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row between 0 and 1; 1 where every tree isolates it at once."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, value, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(64):
                inner = column[at] >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(column[at], 0)] < value[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(_expected(self.rows), 1e-9))


def fit(stats: DataFrame, good: DataFrame, id: str = "doc_id", sample: int = SAMPLE) -> Forest | None:
    """A forest of at most ``sample`` rows whose id is in ``good``, or of all rows if none is; None without two rows."""
    wanted = stats.where(~base_failed()).select(id, *COUNTS).withColumn("all", F.lit(1))
    rows = wanted.join(good.select(id).distinct(), id, "left_semi")
    for source in (rows, wanted):
        chosen = bounded(source, F.xxhash64(id, *COUNTS, F.lit(5)), "all", sample)
        x = shares(np.array(sorted(tuple(r) for r in chosen.select(*COUNTS).toLocalIterator()), dtype=np.int64).reshape(-1, len(COUNTS)))
        if len(x) > 1:
            return Forest(x)
    return None


def scored(stats: DataFrame, forest: Forest | None, name: str = "anomaly") -> DataFrame:
    """All columns with the forest's score of each row (0 without a forest)."""
    schema = T.StructType([*stats.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in COUNTS], axis=1) if batch.num_rows else np.zeros((0, len(COUNTS)))
            found = forest.score(shares(x)) if forest else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=schema.names)

    return stats.mapInArrow(run, schema)


def threshold(found: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", good_weight: float = GOOD_WEIGHT) -> float:
    """The score from which refusing costs least over all labelled rows; above 1 (refuse none) without labels of both kinds.

    Labelled rows are counted by score in ``BINS`` bins, so the driver gets two numbers a bin, however many rows there are. Of
    several labels of one id the greatest counts.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(id).agg(F.max(label).alias(label))
    joined = found.where(~base_failed()).select(id, "anomaly").join(known, id)
    rows = joined.groupBy(F.floor(F.col("anomaly") * BINS).alias("bin")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("bad")).collect()
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in rows:
        good[r.bin], bad[r.bin] = r.good, r.bad
    if not good.sum() or not bad.sum():
        return 2.0
    # cost[k]: good rows refused and bad ones kept if rows of bin k and above are refused
    cost = good_weight * np.append(np.cumsum(good[::-1])[::-1][1:], 0) + np.cumsum(bad)
    best = np.flatnonzero(cost == cost.min())
    return float(best[len(best) // 2] + 1) / BINS


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs`` but the text, with the counts, base_failed, anomaly and kept.

    The counts are written to the checkpoint folder once, as they are read four times. A document is kept if the base rules
    don't fail it and its anomaly is below the calibrated threshold. Repeated rows are judged alike and stay; rows of
    unknown id are judged too; an empty table gives an empty result.
    """
    from cellweave.llm.durable import saved

    stats = saved(statistics(docs.drop("anomaly", "base_failed", "kept"), text).drop(text))
    good = labels.where(F.col("quality") == 1)
    found = scored(stats, fit(stats, good, id, sample))
    limit = threshold(found, labels, id)
    failed = base_failed()
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < limit))
