import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from cellweave.llm import line_dedup, queries
from cellweave.llm.textblock import TextBlock

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HERE = "/root/testdata/sf0.001"


def expected(rows, least=40, documents=5):
    """(lines, dropped, kept text) of each (id, text)."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    held = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(k, []).append(-(1 << 63) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= least and len(held[key(x)]) >= documents and max(held[key(x)]) != (-(1 << 63) if i is None else i) for x in lines]
        out.append((len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def made(n, seed):
    rnd = random.Random(seed)
    common = ["Résumé der Ünicode ÀB" * 2, "a line that many hold " * 2, "short", "漢字" * 20, "漢字" * 19 + "x", "x" * 39, "y" * 40, "ÄB" * 20, "äb" * 20]
    pad = ["", " ", "\t", "\r", "\x0b\x0c", "\xa0"]
    rows = [(None, "a line that many hold " * 2), (None, None), (3, ""), (4, "\n"), (5, "\n\n a \n"), (5, "\n".join(common)), (7, " \n" + "\n".join(common) + "\n")]
    for k in range(n):
        lines = [rnd.choice(pad) + (x.upper() if rnd.random() < 0.2 else x) + rnd.choice(pad) for x in rnd.choices([*common, f"only here {k} " * 5], k=rnd.randint(0, 6))]
        rows.append((rnd.choice([None, rnd.randint(-50, 50)]) if k % 9 == 0 else 100 + k, "\n".join(lines)))
    rows += rows[-5:] + [(1000, None), (1000, rows[8][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batches,buckets,documents", [(1, 1, 1, 5), (2, 7, 3, 5), (3, 4, 9, 2), (4, 30, 2, 9)])
def test_against_brute_force(spark, seed, batches, buckets, documents):
    rows = made(60, seed)
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k long, doc_id long, text string").repartition(3)
    found = line_dedup.drop_repeated_lines(df, min_documents=documents, batches=batches, buckets=buckets).orderBy("k").collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in found] == expected(rows, documents=documents)
    for r in found:
        assert r.kept_text == "\n".join(x for k, x in enumerate((r.text or "").split("\n")) if k not in r.dropped_lines)


def test_equal_hashes_change_nothing(monkeypatch):
    """Hashes that are all alike make every line a suspect; lines are told apart by their texts. The stages are run here, without Spark."""
    monkeypatch.setattr(TextBlock, "span_hashes", lambda self, starts, ends, seed=0: np.full(len(starts), 3, np.uint64))
    rows = made(40, 9)
    tables = [pa.table({"row": pa.array([k] * len(part), pa.int64()), "text": pa.array([t for _, t in part], pa.string()), "id": pa.array([i for i, _ in part], pa.int64()), "batch": pa.array([k] * len(part), pa.int32())}) for k, part in enumerate([rows[:30], rows[30:]])]
    answers = line_dedup._bucket(pa.concat_tables([line_dedup._sender(40, 1)(t) for t in tables]))
    suspects = [r for k, t in enumerate(tables) for r in line_dedup._suspects(40, 1)(t, answers.filter(pc.equal(answers["batch"], k))).to_pylist()]
    found, low = [], -(1 << 63)
    for k, t in enumerate(tables):
        lines = {r["line"] for r in suspects if r["batch"] == k}
        sums = {x: (sum(r["documents"] for r in suspects if r["line"] == x), max((low if r["last"] is None else r["last"]) for r in suspects if r["line"] == x)) for x in lines}
        kept = sorted((x, None if last == low else last) for x, (n, last) in sums.items() if n >= 5)
        confirmed = pa.table({"line": pa.array([x for x, _ in kept], pa.string()), "last": pa.array([x for _, x in kept], pa.int64())})
        found += [(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup._remover(40)(t, confirmed).to_pylist()]
    assert found == expected(rows)


def test_filters():
    rng = np.random.default_rng(4)
    held, others = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (20_000, 50_000))
    tool = line_dedup.Bloom(len(held))
    tool.add(held)
    assert tool.holds(held).all() and tool.holds(others).mean() < 0.01
    assert not line_dedup.Bloom(0).holds(others).any()


def test_a_hot_line(spark):
    """A line of a third of all documents sends one row a batch."""
    df = spark.range(3000).selectExpr("id as doc_id", f"concat('text ', id, '\n', if(id % 3 = 0, repeat('hot ', 15), '')) as text")
    found = line_dedup.drop_repeated_lines(df, batches=8, buckets=4)
    got = {r.doc_id: (r.n_dropped, r.kept_text) for r in found.select("doc_id", "n_dropped", "kept_text").collect()}
    assert all(got[k] == ((1, f"text {k}") if k % 3 == 0 and k != 2997 else (0, f"text {k}\n" + "hot " * 15 * (k % 3 == 0))) for k in range(3000))


def test_long_texts_and_other_columns(spark):
    long = "\n".join(f"line {k} of a text that is long enough to count" for k in range(150_000))
    rows = [(k, long if k < 2 else "x", "r", 2, 3, ["n"]) for k in range(3)] + [(9, "x", "s", 1, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, batch int, n_lines long, line array<string>")
    found = {r.doc_id: r for r in line_dedup.drop_repeated_lines(df, min_documents=2).drop("text").collect()}
    assert (found[0].n_dropped, found[1].n_dropped, found[0].kept_text, found[1].kept_text == long) == (150_000, 0, "", True)
    assert [found[k].row for k in (0, 9)] == ["r", "s"] and found[9].line is None and found[2].batch == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(none).collect() == []
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(none, min_documents=1)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{HERE}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.QUERIES["op11_line_dedup"](spark, HERE).collect()}
    assert found == {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, m, t) in zip(rows, expected(rows))}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{HERE}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.ORACLE_SQL['op11_line_dedup']})").fetchall()} == found
    assert any(m for _, m, _ in found.values())
