"""Texts whose words collide under a polynomial modulo 2^64, and other texts made to look alike."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import jaccard_join, quality_rules, substring_dedup
from cellweave.llm.textblock import TextBlock


def morse(length: int) -> tuple[str, str]:
    """The Thue-Morse word of a length, and its complement."""
    bits = [bin(n).count("1") % 2 for n in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("length", [8, 64, 512, 2048, 4096])
def test_no_collision_by_construction(length):
    a, b = morse(length)
    swapped = [a, b, a[::-1] + "c", a + "\0", a + "\0\0", "\0" + a, a[: length // 2] + b[: length // 2], a[8:] + a[:8]]
    for seed in (0, 7):
        found = TextBlock(pa.array([" ".join(swapped)])).word_hashes(seed)
        assert len(set(found.tolist())) == len(set(swapped))


def test_hash_depends_on_bytes_alone():
    words = ["".join(w) for n in range(1, 4) for w in itertools.product("aBé", repeat=n)] + ["x" * n for n in range(1, 1100, 7)]
    alone = [TextBlock(pa.array([w])).word_hashes()[0] for w in words]
    rng = np.random.default_rng(1)
    order = rng.permutation(len(words))
    together = TextBlock(pa.array([" ".join(words[k] for k in order), None, ""])).word_hashes()
    assert together.tolist() == [alone[k] for k in order]
    assert len(set(alone)) == len(words)
    assert TextBlock(pa.array(["AB É x"]), lower=True).word_hashes().tolist() == TextBlock(pa.array(["ab É x"])).word_hashes().tolist()


@pytest.mark.parametrize("length", [512, 2048])
def test_operators_tell_such_words_apart(spark, length):
    a, b = morse(length)
    rows = [(1, " ".join(f"{a}{k}" for k in range(25))), (2, " ".join(f"{b}{k}" for k in range(25))), (3, f"{a}\n{b}"), (4, " ".join([a] * 21)), (5, " ".join([b] * 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 20, 5: 0}  # the second window of 4 repeats its first
    linked = {r.doc_id: r.component_id for r in jaccard_join.components(docs.where("doc_id <> 3")).collect()}
    assert linked == {k: k for k in (1, 2, 4, 5)}
    lines = {r.doc_id: r.n_dup_lines for r in quality_rules.statistics(docs).collect()}
    assert set(lines.values()) == {0}
