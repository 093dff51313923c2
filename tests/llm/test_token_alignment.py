import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cellweave.llm import queries, token_alignment
from cellweave.llm.byte_bpe import byte_characters

FIRST, SECOND = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
HERE = "/root/testdata/sf0.001"
_A, _B = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
_A.encode_special_tokens = True
with open(FIRST, encoding="utf-8") as _f:
    _SHOWN = {k: t for t, k in json.load(_f)["model"]["vocab"].items()}
_BYTE = {c: b for b, c in enumerate(byte_characters())}


def tokens(text):
    """The groups of a text, each (first ids, second ids), by whole-text encoding and byte offsets."""
    if not text:
        return []
    a, b = _A.encode(" " + text, add_special_tokens=False).ids, _B.encode(text)
    a_raw = [bytes(_BYTE[c] for c in _SHOWN[k]) for k in a]
    b_raw = [bytes([int(_B.id_to_piece(k)[3:-1], 16)]) if _B.is_byte(k) else _B.id_to_piece(k).replace("▁", " ").encode() for k in b]
    if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
        return []
    ends = lambda raw: np.cumsum([len(x) for x in raw]).tolist()
    a_end, b_end = ends(a_raw), ends(b_raw)
    out, i, j = [], 0, 0
    for cut in sorted(set(a_end) & set(b_end)):
        n, m = a_end.index(cut) + 1, b_end.index(cut) + 1
        out.append((a[i:n], b[j:m]))
        i, j = n, m
    return out


def expected(texts):
    found = list(map(tokens, texts))
    linked = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in found]
    documents = Counter(p for c in linked for p in c)
    highest = defaultdict(int)
    for (x, _), n in documents.items():
        highest[x] = max(highest[x], n)
    rows = []
    for groups, c in zip(found, linked):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best, total = (sum(n * f(p) for p, n in c.items()) for f in (lambda p: documents[p] == highest[p[0]], documents.__getitem__))
        rows.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()), best, total, hashlib.sha256(shown.encode()).hexdigest() if groups else "", shown))
    return rows


EDGES = [None, "", " ", "  ", "a ", " a", "a  b", "\n", " \n a", "a\n b  \t c", "<|endoftext|> <s> </s> <unk> <0x41>", "▁", "a▁b", "漢字かな", "😀 👩‍👩‍👧 é ﬁ", "\0 a\0b", "\x1c \x85 a　b", "a  b", "don't 12345 --", "a​ b", "﻿x", "\r\n x", "x" * 500, "漢字" * 300, "—" * 200]


def made(n, seed):
    rnd = random.Random(seed)
    parts = ["the", " the", " of", "  ", "\n", "Äpfel", " größer", "12", " 3.5", "tion", "ing", "漢", "\t", "'s", "😀", "é", " —", "qu"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(n)]


def test_groups():
    of_a, of_b = token_alignment.groups_of(np.array([1, 2, 1, 3, 3]), np.array([1, 1, 2, 6]))
    assert of_a.tolist() == [0, 1, 1, 2, 2] and of_b.tolist() == [0, 1, 1, 2]
    whole = [(a.tolist(), b.tolist()) for a, b in token_alignment.links(of_a, of_b)]
    assert whole == [([0, 1, 1, 2, 2, 3, 4], [0, 1, 2, 1, 2, 3, 3])]
    left = token_alignment.Csr(np.array([0, 2, 2, 3]), np.array([0, 1, 1]))
    right = token_alignment.Csr(np.array([0, 2, 4]), np.array([1, 3, 0, 3]))
    for limit in (1, 3, 100):
        parts = list(token_alignment.product(left, right, limit))
        assert [np.concatenate(x).tolist() for x in zip(*parts)] == [[0, 0, 0, 2, 2], [0, 1, 3, 0, 3], [1, 1, 2, 1, 1]]


@pytest.mark.parametrize("seed,limit,buckets", [(1, 1 << 20, 1), (2, 64, 5), (3, 700, 40)])
def test_against_brute_force(spark, seed, limit, buckets):
    texts = EDGES + made(120, seed) + ["the tion"] * 5
    df = spark.createDataFrame([(k, t, "b", k % 3) for k, t in enumerate(texts)], "k long, text string, batch string, pairs long").repartition(3)
    found = token_alignment.align(df, FIRST, SECOND, groups=True, batch_bytes=limit, buckets=buckets).orderBy("k").collect()
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in found] == expected(texts)
    assert [(r.batch, r.pairs) for r in found] == [("b", k % 3) for k in range(len(texts))]


def test_slices_and_blocks_change_nothing(monkeypatch):
    texts = EDGES + made(60, 5)
    tool = token_alignment.Aligner(FIRST, SECOND)
    counts, pieces, pairs, times = tool.align(texts)
    monkeypatch.setattr(token_alignment, "ENCODED_AT_ONCE", 3)
    monkeypatch.setattr(token_alignment, "product", lambda left, right, limit=7, f=token_alignment.product: f(left, right, limit))
    again = [tool.align([t]) for t in texts]
    assert np.concatenate([x[0] for x in again]).tolist() == counts.tolist() and [x[1][0] for x in again] == pieces
    assert [x[2][0].tolist() for x in again] == [p.tolist() for p in pairs] and [x[3][0].tolist() for x in again] == [t.tolist() for t in times]


def test_long_text(spark):
    """A text of several slices' size, with a division of 200,000 characters."""
    text = "word " * 1_000_000 + "漢" * 200_000
    found = token_alignment.align(spark.createDataFrame([(1, text), (2, "word")], "doc_id long, text string"), FIRST, SECOND).orderBy("doc_id").collect()
    assert found[0].n_groups > 1_000_000 and found[0].n_best == found[0].n_links and found[1].n_links == found[1].count_sum / 2 == 1


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(none, FIRST, SECOND).collect() == []
    nulls = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert {(r.n_a, r.n_links, r.groups_sha256) for r in token_alignment.align(nulls, FIRST, SECOND).collect()} == {(0, 0, "")}


def test_query(spark):
    rows = spark.read.parquet(f"{HERE}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_token_alignment"](spark, HERE).collect()}
    assert found == {r.doc_id: e[:7] for r, e in zip(rows, expected([r.text for r in rows]))}
