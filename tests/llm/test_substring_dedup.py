import hashlib
import random
import re

import pytest
import xxhash

from cellweave.llm import queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tie(text):
    """Spark's xxhash64 of a text, as a signed number; of null: the seed."""
    n = 42 if text is None else xxhash.xxh64(text.encode(), seed=42).intdigest()
    return n - (1 << 64) if n >= 1 << 63 else n


def expected(rows, window):
    """(words, removed, kept text) of each (id, text), in the order of the rows."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, tie(rows[k][1]), rows[k][1] or ""))
    seen, out = set(), [None] * len(rows)
    for k in order:
        words = WORD.findall(rows[k][1] or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[k] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def made(n, seed):
    rnd = random.Random(seed)
    words = ["a", "b", "cé", "漢字", "d,", "E"]
    passages = [[rnd.choice(words) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(3, 30))] for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(words) for _ in range(rnd.randint(0, 9))] for _ in range(rnd.randint(0, 5))]
        rows.append((k, rnd.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    return rows


@pytest.mark.parametrize("window,start,batches,buckets", [(20, None, 1, 1), (20, 5, 5, 3), (6, 3, 8, 2), (7, None, 3, 7), (20, 3, 7, 5), (20, 10, 2, 1)])
def test_against_brute_force(spark, window, start, batches, buckets):
    rows = [*made(120, window), (None, None), (None, "x " * 30), (None, "z " * 30 + "x " * 30), (500, "y " * 30), (500, "y " * 30), (500, "q " + "y " * 30), (501, ""), (502, "w" * 5000), (503, "same " * 3000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, start int")
    found = substring_dedup.remove_repeats(df, window, start, batches=batches, buckets=buckets).collect()
    want = expected(rows, window)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_words, r.n_removed, r.kept_text, r.start) for r in found) == sorted((i is None, i or 0, t or "", *w, 7) for (i, t), w in zip(rows, want))
    for r in found:
        assert sum(s["end"] - s["start"] for s in r.removed_spans) == r.n_removed


def test_levels():
    assert substring_dedup.levels(20, 5) == [5, 10, 20] and substring_dedup.levels(20, 3) == [3, 6, 12, 20] and substring_dedup.levels(7, 2) == [2, 4, 7]


def test_helper_names_are_free(spark):
    df = spark.createDataFrame([(1, "a b c", 3, 4, "r"), (2, "a b c", 5, 6, "s")], "doc_id long, text string, batch int, tie int, row string")
    found = substring_dedup.remove_repeats(df, 2, 1).orderBy("doc_id").collect()
    assert [(r.batch, r.tie, r.row, r.n_removed) for r in found] == [(3, 4, "r", 0), (5, 6, "s", 3)]


def test_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_text(spark):
    """A text of some 12 MB is one batch and keeps its only copies of each window."""
    rnd = random.Random(9)
    long = " ".join(f"{rnd.randint(0, 10**9):x}" for _ in range(1_500_000))
    df = spark.createDataFrame([(1, long), (2, long[: len(long) // 2] + " tail")], "doc_id long, text string")
    found = {r.doc_id: r for r in substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed").collect()}
    assert found[1].n_removed == 0 and found[2].n_words - found[2].n_removed in (1, 2)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op2_substring_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert found == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, m, t) in zip(rows, expected(rows, 20))}
