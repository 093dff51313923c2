import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from cellweave.llm import hmm_lm, queries
from cellweave.llm.batching import from_numbers, numbers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def base(rows):
    counts = Counter(w for _, text, train in rows if train for w in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text, _ in rows:
        t = tokens(text)
        out.append((i, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)))
    return out


def test_recursions_against_enumeration():
    rng = np.random.default_rng(1)
    k, c = 3, 5
    start, step, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T
    sequences = [rng.integers(0, c, n) for n in (4, 1, 0, 3)]
    first, words = np.append(0, np.cumsum([len(s) for s in sequences])), np.concatenate(sequences)
    of_words, starts, steps, log10 = hmm_lm.expected(start, step, emit, words, first)
    want = [np.zeros((c, k)), np.zeros(k), np.zeros((k, k))]
    logs = hmm_lm.log_likelihood(start, step, emit, words, first)
    for s, logp in zip(sequences, logs):
        paths = {z: start[z[0]] * np.prod([emit[x, y] for x, y in zip(s, z)]) * np.prod([step[a, b] for a, b in zip(z, z[1:])]) for z in itertools.product(range(k), repeat=len(s)) if z}
        total = sum(paths.values())
        assert np.isclose(np.log10(total), logp) if len(s) else logp == 0
        for z, p in paths.items():
            want[1][z[0]] += p / total
            for x, y in zip(s, z):
                want[0][x, y] += p / total
            for a, b in zip(z, z[1:]):
                want[2][a, b] += p / total
    assert np.allclose(of_words, want[0]) and np.allclose(starts, want[1]) and np.allclose(steps, want[2]) and np.isclose(log10, logs.sum())


def test_long_texts_in_pieces(monkeypatch):
    """The recursions within pieces give what they give over whole texts, in chunks of any size."""
    rng = np.random.default_rng(7)
    k, c = 4, 30
    start, step, emit = rng.dirichlet(np.ones(k) * 0.3), rng.dirichlet(np.ones(k) * 0.2, k), rng.dirichlet(np.ones(c) * 0.1, k).T + 1e-9
    sequences = [rng.integers(0, c, n) for n in (5, 700, 0, 1, 64, 65, 129)]
    first, words = np.append(0, np.cumsum([len(s) for s in sequences])), np.concatenate(sequences)
    want = hmm_lm.expected(start, step, emit, words, first), hmm_lm.log_likelihood(start, step, emit, words, first)
    for piece, chunk in ((64, 1 << 18), (3, 50), (1, 1)):
        monkeypatch.setattr(hmm_lm, "PIECE", piece)
        monkeypatch.setattr(hmm_lm._chunks, "__defaults__", (chunk,))
        found = hmm_lm.expected(start, step, emit, words, first), hmm_lm.log_likelihood(start, step, emit, words, first)
        assert all(np.allclose(x, y, rtol=1e-9) for x, y in zip(found[0], want[0])) and np.allclose(found[1], want[1], rtol=1e-12)


def test_counts_are_whole_parts():
    """Each token's parts add up to the unit, and a state's parts over many tokens come close to what is expected."""
    rng = np.random.default_rng(8)
    start, step, emit = np.ones(3) / 3, np.eye(3) * 0.7 + 0.1, rng.dirichlet(np.ones(20), 3).T
    words, first = rng.integers(0, 20, 6000), np.array([0, 4000, 4001, 6000])
    exact = hmm_lm.expected(start, step, emit, words, first)[0]
    parts = hmm_lm.expected(start, step, emit, words, first, 255)[0]
    assert (parts == np.rint(parts)).all() and (parts.sum(1) == 255 * np.bincount(words, minlength=20)).all()
    assert np.abs(parts / 255 - exact).max() < 0.15  # of some 300 tokens a word


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 7 != 2 as train")
    want = None
    for parts in (1, 4, 7):
        found = {r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in hmm_lm.score(docs.repartition(parts), "train").collect()}
        want = want or found
        assert len(found) == len(want) and all(np.allclose(found[i], x, rtol=1e-9, atol=0) for i, x in want.items())


def test_numbers_of_any_width():
    for top in (0, 255, 256, 1 << 33, 1 << 62):
        values = np.array([[0, top], [top, 1], [7, 0]])
        assert (from_numbers(numbers(values), 2) == values).all()
    assert from_numbers(numbers(np.zeros((0, 2), np.int64)), 2).shape == (0, 2)


def plain(rows, states, passes):
    """The operator in plain Python: dictionaries of words, one text after the other, nothing packed or rounded."""
    from cellweave.llm.textblock import SPACED, TextBlock

    used = [t for _, t, train in rows if train]
    block = TextBlock(pa.array([t or "" for t in used]), SPACED, lower=True)
    x = hmm_lm.endings(block)
    kinds = hmm_lm.Kinds(len(x), x.sum(0), x.T @ x, states).of(block)
    counts = Counter(w for t in used for w in tokens(t))
    found = {w: np.zeros(states) for w in counts}
    for t, z in zip(used, kinds):
        for w in tokens(t):
            found[w][z] += 1
    n, v = sum(counts.values()), len(counts)
    of_state = sum(found.values())
    sums = hmm_lm.Sums.none(states)
    sums.steps[:], sums.starts[:] = (np.eye(states) * 0.85 + 0.15 / states) * of_state[:, None], of_state / n

    def emission(w):
        words_of = sum(x / x.sum() for x in found.values())
        size = np.where(of_state > 0, of_state, 1)
        own = found[w] / counts[w] * (counts[w] - hmm_lm.DISCOUNT) / size if w in counts else 0
        spared = np.where(of_state > 0, hmm_lm.DISCOUNT * words_of / size, 1)  # a state without tokens follows the base
        return own + spared * (0.5 * (counts[w] + 1) / (n + v + 1) + 0.5 / (v + 1))

    def model():
        return (sums.starts + 1) / (sums.starts + 1).sum(), (sums.steps + 1) / (sums.steps + 1).sum(1, keepdims=True), {w: emission(w) for w in {w for _, t, _ in rows for w in tokens(t)}}

    for _ in range(passes):
        start, step, emit = model()
        new = hmm_lm.Sums.none(states)
        found = {w: np.zeros(states) for w in counts}
        for t in used:
            words = tokens(t)
            local = np.stack([emit[w] for w in words])
            of_words, starts, steps, _ = hmm_lm.expected(start, step, local, np.arange(len(words)), np.array([0, len(words)]))
            for w, x in zip(words, of_words):
                found[w] += x
            new.starts += starts
            new.steps += steps
        sums, of_state = new, sum(found.values())
    start, step, emit = model()
    out = []
    for i, t, _ in rows:
        words = tokens(t)
        out.append((i, float(hmm_lm.log_likelihood(start, step, np.stack([emit[w] for w in words]), np.arange(len(words)), np.array([0, len(words)]))[0])))
    return out


def test_against_plain_version_at_any_number_of_batches(spark):
    rng = np.random.default_rng(3)
    topics = [[f"{a}{k}{e}" for k in range(40)] for a, e in (("x", "en"), ("y", "os"), ("z", "ul"))]
    rows = [(k, " ".join(rng.choice(topics[k % 3], 30)) + (f" rare{k}" if k % 4 else ""), k % 5 != 0) for k in range(90)]
    want = plain(rows, 4, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    for parts, buckets in ((1, 1), (3, 2), (7, 5)):
        size = hmm_lm.Sizes(1 << 20)
        size.buckets = buckets
        found = {r.doc_id: r.score for r in hmm_lm.score(df.repartitionByRange(parts, "doc_id"), "train", states=4, passes=2, tolerance=-1.0, size=size).collect()}
        assert all(abs(found[i] - x) < 0.005 * abs(x) for i, x in want)


def test_query(spark):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = queries.QUERIES["op9_hmm_lm"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == sorted(base(rows))
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    rows = [(1, "A b  b\n", True), (2, None, True), (3, "", False), (None, "zz a", None), (4, "b " * 9000, True), (4, "b " * 9000, True)]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, train boolean, score int, bucket string, batch int")
    for parts in (1, 3):
        found = hmm_lm.score(df.repartition(parts), "train").collect()
        assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == sorted((i or 0, *rest) for i, *rest in base(rows))
        assert all(math.isfinite(r.score) and r.score <= 0 and (r.bucket, r.batch) == ("k", 2) for r in found)
    none = hmm_lm.score(df.withColumn("train", df.train & False), "train").collect()
    assert {(r.base_score, round(r.score, 9)) for r in none} == {(0.0, 0.0)}
    assert hmm_lm.score(df.limit(0), "train").count() == 0


def test_probabilities_sum_to_one():
    """Over all training words and one unknown, a state's emissions sum to one; bytes lose little of the shares."""
    rng = np.random.default_rng(2)
    counts, shares = rng.integers(1, 50, 200), rng.dirichlet(np.ones(3) * 0.2, 200)
    sent = hmm_lm.from_bytes(hmm_lm.to_bytes(shares).tobytes(), 3)
    assert np.abs(sent - shares).max() < 0.01
    sums = hmm_lm.Sums.none(3)
    sums.vector[2:4] = 200, counts.sum()
    sums.of_state[:], sums.words_of[:] = counts @ sent, sent.sum(0)
    emit = hmm_lm.Model(sums).emissions(np.append(counts, 0), np.vstack([sent, np.zeros(3)]))
    assert np.allclose(emit.sum(0), 1)


def test_a_batch_is_coded_and_back():
    rng = np.random.default_rng(4)
    for n in (1, 70000):
        place, own, sizes = rng.permutation(n), rng.integers(0, n, 100), np.array([0, 60, 40])
        words, first, used = hmm_lm.uncoded(hmm_lm.coded(own, place, np.append(0, np.cumsum(sizes)), np.array([True, False, True])))
        assert (words == place[own]).all() and first.tolist() == [0, 0, 60, 100] and used.tolist() == [True, False, True]


def test_rounds_end_by_likelihood(spark, monkeypatch):
    rounds = []
    learner = hmm_lm._learner
    monkeypatch.setattr(hmm_lm, "_learner", lambda *a: rounds.append(1) or learner(*a))
    df = spark.createDataFrame([(k, "a b c d " * 5, True) for k in range(10)], "doc_id long, text string, train boolean")
    hmm_lm.score(df, "train").count()
    assert 1 < len(rounds) < hmm_lm.PASSES
