import random
import re

import pytest

from cellweave.llm import jaccard_join, queries
from cellweave.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def expected(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]):
                label[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, len(s), least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def made(n, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randint(0, 60))
    bases = [[word() for _ in range(rnd.randint(1, 60))] for _ in range(5)]
    rows = []
    for k in range(n):
        words = list(rnd.choice(bases)) if rnd.random() < 0.8 else [word() for _ in range(rnd.randint(0, 50))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            if words:
                words[rnd.randrange(len(words))] = word()
        rows.append((n - k, rnd.choice([" ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("words,percent,batches,block", [(3, 90, 1, 4096), (5, 80, 6, 4096), (2, 80, 3, 7), (3, 70, 4, 5)])
def test_against_brute_force(spark, words, percent, batches, block):
    rows = [*made(160, words + percent), (None, None), (900, ""), (901, "A b"), (902, "a B"), (902, "a b"), (903, "a"), (None, "q r s t"), (None, "q r s t"), (904, "x " * 4000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, component_id string")
    found = jaccard_join.components(df, words, percent, batches=batches, buckets=3, block_classes=block).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(expected(rows, words, percent), key=key)


def test_helper_names_are_free(spark):
    df = spark.createDataFrame([(77, "a b c", 1, b"x", "t"), (88, "A b c", 2, b"y", "u")], "doc_id long, text string, batch int, class binary, row string")
    found = jaccard_join.components(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.batch, bytes(r["class"]), r.row, r.component_id) for r in found] == [(77, 1, b"x", "t", 77), (88, 2, b"y", "u", 77)]


def test_bytes_bound_blocks(spark, monkeypatch):
    """Blocks by bytes find the same components as blocks by number."""
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 2000)
    rows = made(120, 11)
    found = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70, batches=2, buckets=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(expected(rows, 3, 70))


def test_empty(spark):
    assert jaccard_join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(70)] + [(200 + k, 201 + k) for k in range(40)] + [(500, 500), (None, 3)]
    found = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if None not in e for x in e}
    for _ in label:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert len(set(zip(found.values(), label.values()))) and {(found[x], label[x]) for x in label} and len({(found[x], label[x]) for x in label}) == len(set(label.values())) == len(set(found.values()))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op3_jaccard_join"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(expected(rows, 3, 90))
