"""A hidden Markov language model over a whole corpus, beside an add-one unigram model.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. Every training word has emissions of its own in
every state, so the parameters grow with the vocabulary, but no task holds them all: a batch of documents exchanges its
own words with hash buckets. A bucket adds up the batches' expected counts of its words and answers each batch with
the sums of the words that it asked for. The driver holds starts, steps and totals of the states only.

The texts are coded once: a batch's words, and each text as numbers of these. Each round of Baum-Welch then runs over
all training texts in coded form, until the likelihood of a token gains less than a tolerance. The start values come from
all training texts too: their word endings' main directions of variance part them into as many kinds as there are states.

A token's expected counts by state are rounded to whole 255ths that add up to one token, by an offset that its place in its
text gives, so that rounding favours no state. Batches send sums of these whole numbers, which are the same however the
corpus is cut into batches. Buckets answer with bytes: the square roots of the states' shares in 255ths. They take the totals
of the states from the very shares that they send, so the model's probabilities sum to one. A text's score is the scaled
forward recursion's exact log-likelihood under that model.

A text of more than ``PIECE`` tokens is cut into pieces that are worked on side by side: products of the steps' matrices tell
what enters each piece from either side, and the recursions then run within the pieces, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.batching import KEY, Sizes, blobs, by_bucket, from_numbers, from_planes, gathered, numbers, packed, planes, rows_of, sizes, table_of, unpacked
from cellweave.llm.durable import discard, saved
from cellweave.llm.textblock import SPACED, TextBlock, mix, slices

STATES = 8
#: Rounds of Baum-Welch at most, and the gain in log10 likelihood of a token below which they end.
PASSES = 10
TOLERANCE = 0.01
#: What each word's count gives up; a state spends the sum of that on all words alike and on the base model, by halves.
DISCOUNT = 0.6
#: Kinds of word endings that the start values are made from.
ENDINGS = 64
#: Tokens whose forward and backward values a task holds at once.
CHUNK_TOKENS = 1 << 18
#: Tokens that a recursion takes one after the other.
PIECE = 2048
#: Parts that a token's count is dealt to the states in.
UNIT = 255
#: Steps of the offsets of rounding (the golden section: any run of places meets all offsets alike).
OFFSET = 0.6180339887498949
END = np.uint64(0xFFFFFFFFFFFFFFFE)
#: Batches whose sums one task adds up.
_FAN_IN = 64
_SENT = f"bucket int, {KEY} long, words binary, found binary"
_MADE = f"bucket int, {KEY} long, found binary, sums array<double>"
_COUNTED = f"bucket int, {KEY} long, counts binary, shares binary, links binary, sums array<double>"


def tokens(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, n+1 token offsets): each text's words, then an end."""
    first = block.first + np.arange(block.n + 1)
    hashes = np.full(first[-1], END)
    hashes[np.arange(block.words) + block.doc_of_word()] = block.word_hashes()
    return hashes, first


def endings(block: TextBlock) -> np.ndarray:
    """For each text the square roots of its words' shares by kind of ending (the last two bytes), in whole 1024ths, whose
    sums and products are exact in any order."""
    last = block.data[block.ends - 1].astype(np.uint64) if block.words else np.zeros(0, np.uint64)
    before = np.where(block.ends - block.starts > 1, block.data[np.maximum(block.ends - 2, 0)], 0).astype(np.uint64) if block.words else last
    kind = (mix(last << np.uint64(8) | before) % np.uint64(ENDINGS)).astype(np.int64)
    found = np.bincount(block.doc_of_word() * ENDINGS + kind, minlength=block.n * ENDINGS).reshape(block.n, ENDINGS)
    return np.rint(1024 * np.sqrt(found / np.maximum(block.counts, 1)[:, None])) / 1024


class Kinds:
    """Parts texts into ``states`` kinds by the signs of their endings along the main directions of variance."""

    def __init__(self, n: float, total: np.ndarray, squares: np.ndarray, states: int):
        self.states = states
        self.mean = total / max(n, 1)
        spread = squares / max(n, 1) - np.outer(self.mean, self.mean)
        _, axes = np.linalg.eigh(np.round(spread, 12))
        axes = axes[:, ::-1][:, : max(1, (states - 1).bit_length())]
        self.axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])

    def of(self, block: TextBlock) -> np.ndarray:
        side = np.round((endings(block) - self.mean) @ self.axes, 9) > 0
        return (side @ (1 << np.arange(side.shape[1]))) % self.states


def kinds(train: DataFrame, text: str, states: int) -> Kinds:
    """From sums over all texts, added up by Spark as plain rows."""
    upper = np.triu_indices(ENDINGS)

    def run(batches):
        total = np.zeros(1 + ENDINGS + len(upper[0]))
        for batch in slices(batches, text):
            x = endings(TextBlock(batch.column(0), SPACED, lower=True))
            total[0] += len(x)
            total[1 : 1 + ENDINGS] += x.sum(0)
            total[1 + ENDINGS :] += (x.T @ x)[upper]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

    found = np.zeros(1 + ENDINGS + len(upper[0]))
    for r in train.select(text).mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        found[r.place] = r.value
    squares = np.zeros((ENDINGS, ENDINGS))
    squares[upper] = found[1 + ENDINGS :]
    return Kinds(found[0], found[1 : 1 + ENDINGS], squares + np.triu(squares, 1).T, states)


class Sums:
    """What the driver knows of a model, as one vector of sums: log10 likelihood, tokens that it is of, distinct
    training words, training tokens, tokens and distinct words by state, starts and steps."""

    def __init__(self, vector: np.ndarray, states: int):
        self.vector, k = vector, states
        self.of_state, self.words_of, self.starts, self.steps = vector[4 : 4 + k], vector[4 + k : 4 + 2 * k], vector[4 + 2 * k : 4 + 3 * k], vector[4 + 3 * k :].reshape(k, k)

    @staticmethod
    def size(states: int) -> int:
        return 4 + 3 * states + states * states

    @classmethod
    def none(cls, states: int) -> "Sums":
        return cls(np.zeros(cls.size(states)), states)

    log10 = property(lambda self: self.vector[0])
    seen = property(lambda self: self.vector[1])
    types = property(lambda self: self.vector[2])
    tokens = property(lambda self: self.vector[3])
    #: N + V + 1.
    total = property(lambda self: self.tokens + self.types + 1)


class Model:
    """start (K), step (K x K), and the emissions of words whose counts and shares by state are given."""

    def __init__(self, sums: Sums):
        k = len(sums.of_state)
        start, step = sums.starts + 1.0, sums.steps + 1.0
        self.start, self.step = start / start.sum(), step / step.sum(1, keepdims=True)
        self.total, self.kinds = sums.total, sums.types + 1
        self.of_state = np.maximum(sums.of_state, 1e-300)
        self.spared = np.where(sums.of_state > 0, DISCOUNT * sums.words_of / self.of_state, 1.0)

    def emissions(self, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """A row for each word: its discounted share of the state's tokens, and its part of what the state has spared."""
        own = shares * np.maximum(counts - DISCOUNT, 0.0)[:, None] / self.of_state
        return own + self.spared * (0.5 * (counts + 1.0) / self.total + 0.5 / self.kinds)[:, None]


def to_bytes(shares: np.ndarray) -> np.ndarray:
    """Shares that sum to 1 (or are all 0) as 255ths of their square roots, a plane for each state."""
    return np.ascontiguousarray(np.rint(255 * np.sqrt(np.clip(shares, 0, 1))).astype(np.uint8).T)


def from_bytes(blob, states: int) -> np.ndarray:
    """The shares that bytes stand for, made to sum to 1 again (or all 0)."""
    found = (np.frombuffer(blob, np.uint8).reshape(states, -1).T / 255.0) ** 2
    return found / np.maximum(found.sum(1, keepdims=True), 1e-300)


class Steps:
    """Sequences side by side: their tokens in order of the step, and at each step the longer sequences first.
    ``sequence`` and ``place`` tell which sequence and which token each is."""

    def __init__(self, first: np.ndarray):
        n = np.diff(first)
        self.order = np.argsort(-n, kind="stable")
        n = n[self.order]
        self.active = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
        self.at = np.append(0, np.cumsum(self.active))
        row = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.active)
        self.sequence = self.order[row]
        self.place = first[:-1][self.sequence] + np.repeat(np.arange(len(self.active)), self.active)
        some = self.active[0] if len(self.active) else 0
        #: Where the last token of each sequence that has one stands.
        self.last = self.at[n[:some] - 1] + np.arange(some)


def forward(enter: np.ndarray, step: np.ndarray, local: np.ndarray, s: Steps) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values of all tokens, and the scales (their product is a sequence's probability). ``enter`` holds, for
    each sequence, the states' probabilities at its first token."""
    values, scales = np.empty_like(local), np.empty(len(local), local.dtype)
    before = None
    for t, k in enumerate(s.active):
        a = s.at[t]
        now = local[a : a + k] * (enter[s.order[:k]] if before is None else before[:k] @ step)
        norm = now.sum(1)
        now /= norm[:, None]
        values[a : a + k], scales[a : a + k], before = now, norm, now
    return values, scales


def transfers(start: np.ndarray, step: np.ndarray, local: np.ndarray, s: Steps, opening: np.ndarray) -> np.ndarray:
    """For each sequence the product of its tokens' matrices (step, then emission), up to a factor. An opening sequence
    starts anew: its first matrix leads from any state to the starts."""
    k = len(start)
    out, before = np.zeros((len(s.order), k, k)), None
    for t, n in enumerate(s.active):
        e = local[s.at[t] : s.at[t] + n, None, :]
        now = e * (np.where(opening[s.order[:n], None, None], start, step) if before is None else (before[:n].reshape(-1, k) @ step).reshape(n, k, k))
        now /= now.sum((1, 2))[:, None, None]
        ended = s.active[t + 1] if t + 1 < len(s.active) else 0
        out[s.order[ended:n]] = now[ended:]
        before = now
    return out


class Pieces:
    """Texts in pieces of at most ``PIECE`` tokens. For each piece: its text, whether it opens it, the states' probabilities
    at the token before (``before``) and at its first token (``enter``), and, up to a factor, those of all that follows
    the piece by its last token's state (``leave``)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray, tokens: np.ndarray, first: np.ndarray):
        parts = np.maximum(1, -(-np.diff(first) // PIECE))
        self.text = np.repeat(np.arange(len(parts)), parts)
        number = np.arange(len(self.text)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = np.append(first[:-1][self.text] + number * PIECE, first[-1])
        self.opening = number == 0
        self.enter, self.before, self.leave = np.tile(start, (len(self.text), 1)), np.zeros((len(self.text), len(start))), np.ones((len(self.text), len(start)))
        cut = np.flatnonzero(parts[self.text] > 1)
        made = np.zeros((len(self.text) if len(cut) else 0, len(start), len(start)))
        for some, at, s in self.chunks(cut):
            made[some] = transfers(start, step, emit[tokens[at]], s, self.opening[some])
        now = start
        for k in cut:
            if not self.opening[k]:
                self.before[k], self.enter[k] = now, now @ step
            now = now @ made[k]
            now = now / now.sum()
        after = None
        for k in cut[::-1]:
            if after is not None:
                self.leave[k] = after
            after = made[k] @ self.leave[k]
            after = None if self.opening[k] else after / after.sum()

    def chunks(self, which: np.ndarray | None = None):
        """(numbers of pieces, their tokens, their steps), pieces of like length together."""
        size = np.diff(self.first)
        which = np.arange(len(size)) if which is None else which
        which = which[np.argsort(-size[which], kind="stable")]
        within = np.append(0, np.cumsum(size[which]))
        for a, b in _chunks(within):
            s = Steps(within[a : b + 1] - within[a])
            if len(s.place):
                yield which[a:b], s.place + (self.first[which[a:b]] - within[a:b] + within[a])[s.sequence], s


def log_likelihood(start: np.ndarray, step: np.ndarray, emit: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of the probability of each sequence of word numbers."""
    out = np.zeros(len(first) - 1)
    p = Pieces(start, step, emit, tokens, first)
    for some, at, s in p.chunks():
        _, scales = forward(p.enter[some], step, emit[tokens[at]], s)
        out += np.bincount(p.text[some[s.sequence]], np.log10(scales), len(out))
    return out


def expected(start: np.ndarray, step: np.ndarray, emit: np.ndarray, tokens: np.ndarray, first: np.ndarray, unit: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward: (expected counts of each word by state, of starts, of steps, and the sequences' log10 likelihood).
    With a ``unit`` the counts of words are in whole parts of it: each token's add up to ``unit``."""
    k = len(start)
    starts, steps, total = np.zeros(k), np.zeros((k, k)), 0.0
    of_token = np.zeros((k, len(tokens)), np.min_scalar_type(unit) if unit else np.float64)
    p = Pieces(start, step, emit, tokens, first)
    for these, at, s in p.chunks():
        local = emit[tokens[at]]
        values, scales = forward(p.enter[these], step, local, s)
        total += float(np.log10(scales).sum())
        local /= scales[:, None]
        back = np.empty_like(local)
        some = these[s.order[: len(s.last)]]
        back[s.last] = p.leave[some]
        back[s.last] /= (values[s.last] * back[s.last]).sum(1)[:, None]
        for t in range(len(s.active) - 2, -1, -1):
            n, x, y = s.active[t + 1], s.at[t], s.at[t + 1]
            back[x : x + n] = (back[y : y + n] * local[y : y + n]) @ step.T
        local *= back
        after = np.arange(s.at[1], s.at[-1])
        before = after - np.repeat(s.active[:-1], s.active[1:])
        steps += (values[before].T @ local[after] + p.before[some].T @ local[: len(some)]) * step
        values *= back
        starts += values[: len(some)][p.opening[some]].sum(0)
        if unit:
            offset = (at - first[p.text[these]][s.sequence] + 1) * OFFSET % 1.0
            edges = np.minimum(np.floor(np.cumsum(values[:, :-1], axis=1) * unit + offset[:, None]), unit)
            values = np.diff(edges, axis=1, prepend=0, append=unit)
        of_token[:, at] = values.T
    found = np.stack([np.bincount(tokens, x, len(emit)) for x in of_token], axis=1)
    return found, starts, steps, total


# --- a batch in coded form --------------------------------------------------------------------------------------------


def coded(own: np.ndarray, place: np.ndarray, first: np.ndarray, used: np.ndarray) -> bytes:
    """A batch's tokens (numbers of its words by frequency), the place of each of these among the words as they were sent,
    the texts' lengths and which of them are learnt from."""
    parts = [planes(own), planes(place), planes(np.diff(first)), used.astype(np.uint8).tobytes()]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return np.int64(len(head) + sum(map(len, parts))).tobytes() + pa.Codec("zstd").compress(head + b"".join(parts), asbytes=True)


def uncoded(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens as places among the words as they were sent, n+1 offsets, which texts are learnt from)."""
    raw = pa.Codec("zstd").decompress(memoryview(blob)[8:], int(np.frombuffer(blob, np.int64, 1)[0]), asbytes=True)
    at = np.append(32, 32 + np.cumsum(np.frombuffer(raw, np.int64, 4)))
    own, place, sizes_, used = (raw[a:b] for a, b in zip(at[:-1], at[1:]))
    return from_planes(place)[from_planes(own)], np.append(0, np.cumsum(from_planes(sizes_))), np.frombuffer(used, bool)


def _coder(first_kinds: Kinds, buckets: int, batch_bytes: int, schema: pa.Schema):
    """A task's texts in batches: a row for each text (the first of a batch with the whole batch's code), and rows to buckets."""
    states = first_kinds.states

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, table in enumerate(gathered(batches, "text", batch_bytes)):
            key = (task << 32) | number
            block = TextBlock(table.column("text"), SPACED, lower=True)
            hashes, first = tokens(block)
            used = table.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            words, own, n = np.unique(hashes, return_inverse=True, return_counts=True)
            learnt = np.repeat(used, np.diff(first))
            kind = np.repeat(first_kinds.of(block), np.diff(first))
            counts = np.bincount(own[learnt] * states + kind[learnt], minlength=len(words) * states).reshape(-1, states)
            sent = by_bucket((words % np.uint64(buckets)).astype(np.int64), buckets)
            place = np.empty(len(words), np.int64)
            place[np.concatenate([at for _, at in sent])] = np.arange(len(words))
            rank = np.empty(len(words), np.int64)
            order = np.argsort(-n, kind="stable")
            rank[order] = np.arange(len(words))
            blob = coded(rank[own], place[order], first, used)
            nothing = pa.nulls(table.num_rows)
            docs = [table.column("row").combine_chunks(), pa.array(np.full(table.num_rows, key)), pa.array(np.arange(table.num_rows, dtype=np.int32)), pa.array([blob] + [None] * (table.num_rows - 1), pa.binary())]
            yield pa.RecordBatch.from_arrays([*docs, *[nothing.cast(f.type) for f in schema][4:]], schema=schema)
            rows = [(b, key, words[at].tobytes(), numbers(counts[at])) for b, at in sent]
            found = table_of(rows, _SENT)
            columns = {**{f.name: pa.nulls(len(rows), f.type) for f in schema}, **{c: found.column(c).combine_chunks() for c in found.column_names}}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)

    return run


def _bucket_rows(bucket: int, keys: list, ids: list[np.ndarray], found: list[np.ndarray], n: int, unit: int, states: int) -> tuple[list[tuple], np.ndarray]:
    """A bucket's sums over batches: an answer for each batch, and the bucket's own part of the model's sums."""
    sums = np.zeros((n, states), np.int64)
    for at, x in zip(ids, found):
        sums[at] += x
    total = sums.sum(1)
    counts = total // unit
    sent = to_bytes(sums / np.maximum(total, 1)[:, None])
    vector = Sums.none(states)
    vector.vector[2:4] = (counts > 0).sum(), counts.sum()
    shares = from_bytes(sent.tobytes(), states)
    vector.of_state[:], vector.words_of[:] = counts @ shares, (counts > 0) @ shares
    return [(bucket, key, numbers(counts[at, None]), np.ascontiguousarray(sent[:, at]).tobytes()) for key, at in zip(keys, ids)], vector.vector


def _first_bucket(states: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in blobs(table.column("words"))]
        known, which = np.unique(np.concatenate(parts), return_inverse=True)
        ids = np.split(which, np.cumsum([len(p) for p in parts])[:-1])
        found = [from_numbers(x, states) for x in blobs(table.column("found"))]
        bucket = table.column("bucket")[0].as_py()
        rows, vector = _bucket_rows(bucket, table.column(KEY).to_pylist(), ids, found, len(known), 1, states)
        rows = [(*r, packed(at), None) for r, at in zip(rows, ids)]
        return table_of([*rows, (bucket, None, None, None, None, vector.tolist())], _COUNTED)

    return run


def _next_bucket(states: int):
    """The same after a round; a negative bucket only adds up batches' sums."""

    def run(made: pa.Table, links: pa.Table) -> pa.Table:
        if not made.num_rows:
            return table_of([], _COUNTED)
        bucket = made.column("bucket")[0].as_py()
        if bucket < 0:
            return table_of([(bucket, None, None, None, None, np.sum(made.column("sums").to_pylist(), axis=0).tolist())], _COUNTED)
        place = {key: k for k, key in enumerate(links.column(KEY).to_pylist())}
        order = [place[key] for key in made.column(KEY).to_pylist()]
        ids = [unpacked(x) for x in blobs(links.column("links").take(pa.array(order)))]
        found = [from_numbers(x, states) for x in blobs(made.column("found"))]
        n = 1 + max((int(x[-1]) for x in ids if len(x)), default=-1)
        rows, vector = _bucket_rows(bucket, made.column(KEY).to_pylist(), ids, found, n, UNIT, states)
        return table_of([*((*r, None, None) for r in rows), (bucket, None, None, None, None, vector.tolist())], _COUNTED)

    return run


def _answers(table: pa.Table, states: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(counts and shares of a batch's words as they were sent, [(bucket, number of words)])."""
    table = table.sort_by("bucket").combine_chunks()
    counts = [from_numbers(x, 1)[:, 0] for x in blobs(table.column("counts"))]
    shares = [from_bytes(x, states) for x in blobs(table.column("shares"))]
    return np.concatenate(counts), np.concatenate(shares), [(b, len(c)) for b, c in zip(table.column("bucket").to_pylist(), counts)]


def _chunks(first: np.ndarray, limit: int = CHUNK_TOKENS):
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def _learner(model: Model, states: int, lanes: int):
    """A batch's expected counts: a row for each bucket of its words, and its sums."""

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        if not batch.num_rows or not answers.num_rows:
            return table_of([], _MADE)
        key = batch.column(KEY)[0].as_py()
        words, first, used = uncoded(batch.column("blob")[0].as_buffer())
        learnt = np.repeat(used, np.diff(first))
        words, first = words[learnt], np.append(0, np.cumsum(np.diff(first)[used]))
        counts, shares, sent = _answers(answers, states)
        sums = Sums.none(states)
        found, sums.starts[:], sums.steps[:], sums.vector[0] = expected(model.start, model.step, model.emissions(counts, shares), words, first, UNIT)
        sums.vector[1] = len(words)
        edges = np.append(0, np.cumsum([n for _, n in sent]))
        rows = [(b, key, numbers(found[x:y]), None) for (b, _), x, y in zip(sent, edges[:-1], edges[1:])]
        return table_of([*rows, (-1 - hash(key) % lanes, key, None, sums.vector.tolist())], _MADE)

    return run


def _sums(counted: DataFrame, states: int) -> Sums:
    found = Sums.none(states)
    rows = counted.where(f"{KEY} is null").select(F.posexplode("sums").alias("place", "value"))
    for r in rows.groupBy("place").agg(F.sum("value").alias("value")).collect():
        found.vector[r.place] = r.value
    return found


ADDED = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]


def score(docs: DataFrame, train: str, text: str = "text", states: int = STATES, passes: int = PASSES, tolerance: float = TOLERANCE, size: Sizes | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens, n_known, train_tokens, base_score and score for each whole text.

    ``train`` names a boolean column: true rows are learnt from (null counts as false). base_score: the sum over tokens of
    log10((c+1)/(N+V+1)). score: log10 of the hidden Markov model's probability of the text. A null or empty text is one
    end token. Rows of one id or text count once each; without training rows all scores are 0. Columns of the new names are
    replaced. Words are known by 64-bit hashes. Batches are cut from the partitions as they are read, so texts aren't
    shuffled; how they are cut doesn't change the scores, but for the order in which floating-point numbers are added.
    """
    docs = docs.drop(*[f.name for f in ADDED]).withColumn(train, F.coalesce(train, F.lit(False)))
    size = size or sizes(docs, text)
    first_kinds = kinds(docs.where(train), text, states)
    rows = rows_of(docs, text, F.col(train).alias("train"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField(KEY, T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("blob", T.BinaryType())])
    schema = T.StructType([*schema.fields, *[f for f in T._parse_datatype_string(_SENT).fields if f.name != KEY]])
    from pyspark.sql.pandas.types import to_arrow_schema

    made = saved(rows.mapInArrow(_coder(first_kinds, size.buckets, size.batch_bytes, to_arrow_schema(schema)), schema))
    texts, batches = made.where("place is not null").select("row", KEY, "place", "blob"), made.where("blob is not null").select(KEY, "blob")
    sent = made.where("bucket is not null").select("bucket", KEY, "words", "found")
    counted = saved(sent.groupBy("bucket").applyInArrow(_first_bucket(states), _COUNTED))
    links = counted.where(f"{KEY} is not null").select("bucket", KEY, "links")
    sums, now, before = _sums(counted, states), counted, None
    starts = np.eye(states) * 0.85 + 0.15 / states
    sums.steps[:], sums.starts[:] = starts * sums.of_state[:, None], sums.of_state / max(1.0, sums.of_state.sum())
    lanes = 1 + size.batches // _FAN_IN
    for _ in range(passes if sums.tokens else 0):
        answers = now.where(f"{KEY} is not null").select("bucket", KEY, "counts", "shares")
        found = batches.groupBy(KEY).cogroup(answers.groupBy(KEY)).applyInArrow(_learner(Model(sums), states, lanes), _MADE)
        after = saved(found.groupBy("bucket").cogroup(links.groupBy("bucket")).applyInArrow(_next_bucket(states), _COUNTED))
        if now is not counted:
            discard(now)
        now, sums = after, _sums(after, states)
        gain = np.inf if before is None else sums.log10 / sums.seen - before
        before = sums.log10 / max(sums.seen, 1.0)
        if gain < tolerance:
            break
    answers = now.where(f"{KEY} is not null").select("bucket", KEY, "counts", "shares")
    out = T.StructType([texts.schema["row"], *ADDED])
    scored = texts.groupBy(KEY).cogroup(answers.groupBy(KEY)).applyInArrow(_scorer(Model(sums), states, int(sums.tokens)), out)
    kept = [c for c in docs.columns if c != text]
    return scored.select(*[F.col("row")[c].alias(c) for c in kept], *[f.name for f in ADDED])


def _scorer(model: Model, states: int, train_tokens: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.sort_by("place").combine_chunks()
        words, first, _ = uncoded(texts.column("blob")[0].as_buffer())
        counts, shares, _ = _answers(answers, states)
        n = len(first) - 1
        owner = np.repeat(np.arange(n), np.diff(first))
        each = np.log10((counts + 1.0) / model.total)[words]
        emit = model.emissions(counts, shares)
        whole = log_likelihood(model.start, model.step, emit, words, first)
        new = [pa.array(np.diff(first)), pa.array(np.bincount(owner, counts[words] > 0, n).astype(np.int64)), pa.array(np.full(n, train_tokens, np.int64)), pa.array(np.bincount(owner, each, n)), pa.array(whole)]
        return pa.table([texts.column("row"), *new], names=["row", *(f.name for f in ADDED)])

    return run
