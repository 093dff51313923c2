"""Document quality from a linear-chain conditional random field over lines.

Every line with a word gets the label good or bad. Its features are its own statistics and those of the lines before
and after it; a transition weight joins neighbouring labels. Forward-backward gives each line's marginal probability
of being good, and a document's score is their mean, weighted by the lines' lengths. The field is trained by gradient
ascent on the likelihood of labelled documents' lines, each line taking its document's label; all documents of a label weigh
the same there, and so do the labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.durable import saved
from cellweave.llm.sampling import bounded
from cellweave.llm.textblock import SPACED, TextBlock, Windows, by_owner, covered, running, slices

#: Labelled documents of each label to train on at most: those whose ids' hashes are the least.
TRAIN_PER_LABEL = 1500
#: Bytes of text of a training document at most, as the lines' features of all are put together on the driver.
TRAIN_BYTES = 1 << 18
#: Lines of a block. Longer texts are cut into blocks that are worked on side by side.
BLOCK_LINES = 512
THRESHOLD = 0.3

_TABLES = {
    "letters": [*range(0x41, 0x5B), *range(0x61, 0x7B)],
    "upper": range(0x41, 0x5B),
    "digits": range(0x30, 0x3A),
    "wide": range(0x80, 0x100),
    "symbols": b"#*$%&<>@~^_=+\\/",
    "bars": b"|",
    "shouts": b"!?",
    "stops": b".,;:",
}
_CLASSES = np.zeros((len(_TABLES), 256), bool)
for _row, _bytes in zip(_CLASSES, _TABLES.values()):
    _row[list(_bytes)] = True
OWN = len(_TABLES) + 7


def line_features(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with its neighbours', line lengths in bytes, n+1 line offsets of the texts)."""
    starts, ends, first = block.lines()
    n = len(starts)
    size = np.maximum(ends - starts, 1).astype(np.float64)
    first_word, end_word = np.searchsorted(block.starts, starts), np.searchsorted(block.starts, ends)
    words = np.maximum(end_word - first_word, 1).astype(np.float64)
    own = np.empty((n, OWN), np.float64)
    for k, table in enumerate(_CLASSES):
        total = running(table[block.data])
        own[:, k] = (total[ends] - total[starts]) / (size if k < 4 else words)
    own[:, len(_CLASSES)] = np.log1p(words) / 5
    own[:, len(_CLASSES) + 1] = np.minimum(size / words / 10, 4)
    keys = by_owner(block.span_hashes(starts, ends), first)
    again = np.ones(n, bool)
    again[np.unique(keys, return_index=True)[1]] = False
    own[:, len(_CLASSES) + 2] = again
    hashes = block.word_hashes()
    triples = by_owner(Windows(hashes).of(3), block.first)
    fits = np.flatnonzero(block.room() >= 3)
    _, which, count = np.unique(triples[fits], return_inverse=True, return_counts=True)
    repeated = running(covered(fits[count[which] > 1], 3, block.words))
    own[:, len(_CLASSES) + 3] = (repeated[end_word] - repeated[first_word]) / words
    same = np.zeros(block.words, bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[block.first[:-1][block.counts > 0]] = False
    stuck = running(same)
    own[:, len(_CLASSES) + 6] = (stuck[end_word] - stuck[first_word]) / words
    begins, stops = np.zeros(n, bool), np.zeros(n, bool)
    lines = np.diff(first)
    begins[first[:-1][lines > 0]] = True
    stops[first[1:][lines > 0] - 1] = True
    own[:, len(_CLASSES) + 4], own[:, len(_CLASSES) + 5] = begins, stops
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[begins], after[stops] = 0, 0
    return np.concatenate([own, before, after], axis=1), size, first


class Field:
    """Weights of the features and of the four transitions; label 1 is good."""

    def __init__(self, mean, scale, weights, offset, transition):
        self.mean, self.scale, self.weights, self.offset, self.transition = mean, scale, weights, offset, transition

    def potentials(self, x: np.ndarray) -> np.ndarray:
        """How much more likely, in logarithms, a line's own features make good than bad."""
        return (np.clip((x - self.mean) / self.scale, -6, 6) * self.weights).sum(1) + self.offset

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return chain_marginals(self.potentials(x), self.transition, first)[0]

    def scores(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents' scores, the lines' marginals, n+1 line offsets); a text without a word scores 0."""
        x, size, first = line_features(block)
        good = self.marginals(x, first)
        owner = np.repeat(np.arange(block.n), np.diff(first))
        part, whole = (np.bincount(owner, x, block.n) for x in (good * size, size))
        # Rounded, so that copies score alike wherever they stand in a batch.
        return np.round(np.clip(part / np.maximum(whole, 1), 0, 1), 9), good, first


def _blocks(first: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, place in their text) of the blocks that texts are cut into; a text without lines has none."""
    n = np.diff(first)
    per = -(-n // block)
    place = np.arange(per.sum()) - np.repeat(running(per)[:-1], per)
    starts = np.repeat(first[:-1], per) + block * place
    return starts, np.minimum(starts + block, np.repeat(first[1:], per)), place


def _ends_of_blocks(local: np.ndarray, factor: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block the forward values of the line before it and the backward values of its last line, up to a factor.

    A block's lines are one 2 x 2 matrix, their product; all blocks' products are taken at once, and the blocks of a text one after
    the other, so a text takes about as many turns as a block has lines and a text has blocks.
    """
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    begin, longest = starts[order], size[order]
    # The products, and for a text's first block the forward values, as no transition leads into its first line.
    whole, values = np.broadcast_to(np.eye(2), (len(starts), 2, 2)).copy(), np.ones((len(starts), 2))
    for t in range(int(longest[0])):
        k = int(np.searchsorted(-longest, -t, side="left"))
        now = local[begin[:k] + t]
        line = whole[:k] @ (factor * now[:, None, :])
        whole[:k] = line / line.sum((1, 2), keepdims=True)
        values[:k] = (values[:k] @ factor if t else 1) * now
        values[:k] /= values[:k].sum(1, keepdims=True)
    product, plain = np.empty_like(whole), np.empty_like(values)
    product[order], plain[order] = whole, values
    before, after = np.ones((len(starts), 2)), np.ones((len(starts), 2))
    end = np.empty((len(starts), 2))
    head = np.flatnonzero(place == 0)
    end[head] = plain[head] / plain[head].sum(1, keepdims=True)
    for j in range(1, int(place.max()) + 1):
        at = np.flatnonzero(place == j)
        before[at] = end[at - 1]
        now = (end[at - 1][:, None, :] @ product[at])[:, 0]
        end[at] = now / now.sum(1, keepdims=True)
    for j in range(int(place.max()), 0, -1):
        at = np.flatnonzero(place == j)
        now = (product[at] @ after[at][:, :, None])[:, :, 0]
        after[at - 1] = now / now.sum(1, keepdims=True)
    return before, after


def chain_marginals(unary: np.ndarray, transition: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None, block: int = BLOCK_LINES) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward for all texts at once, a line of each block of ``block`` lines at a step.

    Returns the lines' probabilities of label 1, the expected counts of each transition (those into a line weighted by
    ``weight``), and the sum of log partitions.
    """
    starts, ends, place = _blocks(first, block)
    factor = np.exp(transition - transition.max())
    top = np.maximum(unary, 0)
    local = np.stack([np.exp(-top), np.exp(unary - top)], axis=1)
    forward, backward = np.empty_like(local), np.ones_like(local)
    order = np.argsort(-(ends - starts), kind="stable")
    begin, n = starts[order], (ends - starts)[order]
    entry = None
    if (place > 0).any():
        before, after = _ends_of_blocks(local, factor, starts, ends, place)
        backward[ends - 1] = after
        entry, later = before[order] @ factor, (place > 0)[order]
    logz, steps = top.sum(), int(n[0]) if len(n) else 0
    active = [int(np.searchsorted(-n, -t, side="left")) for t in range(steps)]
    for t in range(steps):
        at = begin[: active[t]] + t
        a = (forward[at - 1] @ factor) * local[at] if t else local[at] if entry is None else np.where(later[:, None], entry, 1) * local[at]
        norm = a.sum(1, keepdims=True)
        forward[at] = a / norm
        logz += np.log(norm).sum() + transition.max() * (len(at) if t else 0 if entry is None else later.sum())
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        b = (backward[at + 1] * local[at + 1]) @ factor.T
        backward[at] = b / b.sum(1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / both.sum(1)
    inner = np.ones(len(unary), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    pairs = forward[at - 1][:, :, None] * factor[None] * (local[at] * backward[at])[:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    return good, pairs.sum(0) if weight is None else np.tensordot(weight[at], pairs, 1), float(logz)


def weights_of(y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A weight for each line, so that both labels weigh the same, and within a label all documents, however many lines
    they have; the mean is 1."""
    lines = np.diff(first)
    labels = y[np.minimum(first[:-1], len(y) - 1)]
    documents = np.array([max(1, ((labels == k) & (lines > 0)).sum()) for k in (0, 1)])
    weight = np.repeat(1 / documents[labels] / np.maximum(lines, 1), lines)
    return weight / weight.mean()


def fit(x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> Field:
    """Adam on the lines' conditional log-likelihood, weighted by ``weights_of``; y: 0/1 for each line."""
    weight = weights_of(y, first)
    mean = weight @ x / weight.sum()
    scale = np.sqrt(weight @ (x - mean) ** 2 / weight.sum()) + 1e-3
    z = np.clip((x - mean) / scale, -6, 6)
    weights = np.zeros(x.shape[1] + 1 + 4)
    moved, square = np.zeros_like(weights), np.zeros_like(weights)
    inner = np.ones(len(y), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), weight[at])
    d = x.shape[1]
    for step in range(1, steps + 1):
        good, expected, _ = chain_marginals(z @ weights[:d] + weights[d], weights[d + 1 :].reshape(2, 2), first, weight)
        error = weight * (y - good)
        slope = np.concatenate([z.T @ error, [error.sum()], (seen - expected).ravel()]) / max(1, len(y)) - decay * weights
        moved = 0.9 * moved + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        weights = weights + rate * (moved / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Field(mean, scale, weights[:d], weights[d], weights[d + 1 :].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", per_label: int = TRAIN_PER_LABEL) -> Field | None:
    """A field from at most ``per_label`` labelled documents of each label, or None unless both labels have one.

    The sample is drawn from documents that are there, with a word, and of at most ``TRAIN_BYTES`` of text: labels of others count for
    nothing. Labels other than 0 and 1 are passed over; of several rows of one id the greatest label counts. Only the lines'
    features of the documents chosen reach the driver.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(id).agg(F.max(label).cast("int").alias("label"))
    usable = docs.where(F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]") & (F.octet_length(text) <= TRAIN_BYTES), F.lit(False)))
    present = known.join(usable.select(id), id, "left_semi")
    chosen = saved(bounded(present, F.xxhash64(F.col(id), F.lit(17)), "label", per_label))
    if chosen.select("label").distinct().count() < 2:
        return None
    # At most 2 per_label ids: small enough to be sent to every task.
    rows = usable.select(id, F.col(text).alias("text")).join(F.broadcast(chosen), id).select("label", "text")

    def run(batches):
        for batch in slices(batches, "text"):
            x, _, first = line_features(TextBlock(batch.column(1), SPACED))
            found = [x[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["label", "lines"])

    found = sorted((r.label, bytes(r.lines)) for r in rows.mapInArrow(run, "label int, lines binary").toLocalIterator() if len(r.lines))
    if len({y for y, _ in found}) < 2:
        return None
    parts = [np.frombuffer(lines, np.float32).reshape(-1, 3 * OWN).astype(np.float64) for _, lines in found]
    first = np.append(0, np.cumsum([len(p) for p in parts]))
    whole = np.concatenate(parts)
    return fit(whole, np.repeat([y for y, _ in found], np.diff(first)), first)


ADDED = [T.StructField("score", T.DoubleType()), T.StructField("line_good", T.ArrayType(T.DoubleType()))]


def score(docs: DataFrame, field: Field | None, text: str = "text", lines: bool = True) -> DataFrame:
    """All columns with score (0 to 1, higher is better) and, if ``lines``, the marginals of each line that holds a word.

    A null text or one without words scores 0 and has no lines; without a field every text scores 0.5. The columns
    replace any of their names. A text's result depends on that text alone, so copies score alike.
    """
    added = ADDED if lines else ADDED[:1]
    docs = docs.drop(*[f.name for f in added])
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches):
        for batch in slices(batches, text):
            block = TextBlock(batch.column(batch.schema.get_field_index(text)), SPACED)
            if field is None:
                found, good, first = np.full(block.n, 0.5), np.zeros(0), np.zeros(block.n + 1, np.int64)
            else:
                found, good, first = field.scores(block)
            new = [pa.array(found)] + ([pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(good))] if lines else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)
