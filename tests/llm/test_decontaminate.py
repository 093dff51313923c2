import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import decontaminate, queries
from cellweave.llm.textblock import ALNUM, TextBlock

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(texts, items, window):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if name is None else str(name))
    lengths = sorted({len(k) for k in windows})
    out = []
    for text in texts:
        w, found = words(text), set()
        hit = [False] * len(w)
        for n in lengths:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i : i + n]))
                if names:
                    found |= names
                    hit[i : i + n] = [True] * n
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("window,block_bytes", [(13, 1 << 20), (4, 1 << 20), (3, 200)])
def test_against_brute_force(spark, window, block_bytes):
    rnd = random.Random(window)
    some = ["ab", "Cd", "é1", "漢", "x", "The", "of"]
    text = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choice(some) for _ in range(n))
    items = [(k, text(rnd.randint(0, 20))) for k in range(25)] + [(None, "null item"), (3, text(15)), (99, None), (98, ""), (97, "...")]
    texts = [text(rnd.randint(0, 60)) + " " + (rnd.choice(items)[1] or "") + rnd.choice(["", ",", " x "]) + text(5) for _ in range(150)]
    texts += [None, "", "NULL, item", "x" * 9000, "of " * 4000, texts[0], texts[0]]
    docs = spark.createDataFrame([(k % 140, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(docs, bench, window=window, block_bytes=block_bytes).collect()
    want = expected(texts, items, window)
    key = lambda r: (r[0] is None, r)
    assert sorted([(r.text, r.n_words, r.n_hit, r.hit_items, r.item_id) for r in found], key=key) == sorted([(t, *w, "kept") for t, w in zip(texts, want)], key=key)
    for r in found:
        assert sum(s["end"] - s["start"] for s in r.hit_spans) == r.n_hit


def test_equal_hashes_are_compared_by_bytes(monkeypatch):
    """Were all words of one length equal in hash, only equal bytes would be found."""
    monkeypatch.setattr(TextBlock, "word_hashes", lambda self: (self.ends - self.starts).astype(np.uint64))
    search = decontaminate.Search([("a", "one two SIX"), ("b", "red sky ten"), ("c", "")], 3)
    mask, texts, items = search.hits(TextBlock(pa.array(["so one TWO six", "red sky ton", "Red sky, ten"]), ALNUM, lower=True))
    assert mask.tolist() == [False, True, True, True] + [False] * 3 + [True] * 3
    assert list(zip(texts, [search.names[i] for i in items])) == [(0, "a"), (2, "b")]


def test_words_are_held_once():
    """A search is a few times its benchmark, though every word lies in 13 windows."""
    rnd = random.Random(1)
    text = " ".join(f"w{rnd.randint(0, 50000)}" for _ in range(200_000))
    search = decontaminate.Search([("a", text)], 13)
    held = [search.words, search.bytes, search.begins, search.ends, *(x for p in search.classes for x in (p.shift, p.keys, p.starts))]
    assert sum(x.nbytes for x in {id(x): x for x in held}.values()) < 7 * len(text)


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.hit_items) for r in decontaminate.find(docs, bench).collect()] == [(2, 0, [])]
    assert decontaminate.find(docs.limit(0), bench).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.QUERIES["op5_decontaminate"](spark, folder).collect()}
    want = expected([r.text for r in docs], items, 13)
    assert found == {r.doc_id: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0 and 20 * h >= n) for r, (n, h, i) in zip(docs, want)}
    assert any(x[4] for x in found.values())
