import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np

from cellweave.llm import quality_crf, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.01"


def counted(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, hit = Counter(windows), [0] * len(words)
    for i, k in enumerate(windows):
        if n[k] > 1:
            hit[i : i + 3] = [1] * 3
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)]


def test_chain_against_enumeration():
    rng = np.random.default_rng(0)
    unary, transition, first = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 3, 3, 4, 9])
    good, expected, logz = quality_crf.chain_marginals(unary, transition, first)
    marginals, counts, logs = [], np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        z, m, c = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for ys in itertools.product([0, 1], repeat=int(b - a)):
            w = np.exp(sum(unary[a + i] * y for i, y in enumerate(ys)) + sum(transition[p, q] for p, q in zip(ys, ys[1:])))
            z, m = z + w, m + w * np.array(ys)
            for p, q in zip(ys, ys[1:]):
                c[p, q] += w
        marginals += list(m / z)
        counts, logs = counts + c / z, logs + np.log(z)
    assert np.allclose(marginals, good) and np.allclose(counts, expected) and np.isclose(logs, logz)


def plain_features(text):
    """A text's line features, counted in plain Python, with its neighbours'."""
    raw = text.encode()
    lines = [x for x in raw.split(b"\n") if WORD.search(x.decode())]
    words = [WORD.findall(x.decode()) for x in lines]
    flat = [w for x in words for w in x]
    windows = [tuple(flat[i : i + 3]) for i in range(len(flat) - 2)]
    times, again = Counter(windows), [0] * len(flat)
    for i, k in enumerate(windows):
        if times[k] > 1:
            again[i : i + 3] = [1] * 3
    own, at = [], 0
    for k, (line, mine) in enumerate(zip(lines, words)):
        size, n = max(len(line), 1), max(len(mine), 1)
        inside = [sum(b in set(bytes(table)) for b in line) for table in quality_crf._TABLES.values()]
        own.append([x / (size if j < 4 else n) for j, x in enumerate(inside)])
        stuck = sum(flat[i] == flat[i - 1] for i in range(at, at + len(mine)) if i)
        own[-1] += [np.log1p(n) / 5, min(size / n / 10, 4), line in lines[:k], sum(again[at : at + len(mine)]) / n, k == 0, k == len(lines) - 1, stuck / n]
        at += len(mine)
    none = [0.0] * quality_crf.OWN
    return np.array([x + (own[k - 1] if k else none) + (own[k + 1] if k + 1 < len(own) else none) for k, x in enumerate(own)], float).reshape(-1, 3 * quality_crf.OWN), [len(x) for x in lines]


def test_features_and_query_against_plain_version(spark):
    """The registered query's scores from features and marginals worked out line by line."""
    folder = "/root/testdata/sf0.001"
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    field = quality_crf.train(table.where(~queries.crc_is(5, 0)), labels.where(~queries.crc_is(5, 0)))
    found = {r.doc_id: r for r in queries.QUERIES["op1_quality_crf"](spark, folder).collect()}
    for r in table.collect():
        x, sizes = plain_features(r.text or "")
        score = 0.0
        if len(x):
            unary = [float(np.clip((row - field.mean) / field.scale, -6, 6) @ field.weights + field.offset) for row in x]
            steps, back = np.exp(field.transition), np.ones((len(x), 2))
            ahead = np.zeros((len(x), 2))
            for k, u in enumerate(unary):
                a = np.exp([0, u]) * (ahead[k - 1] @ steps if k else 1)
                ahead[k] = a / a.sum()
            for k in range(len(x) - 2, -1, -1):
                b = steps @ (back[k + 1] * np.exp([0, unary[k + 1]]))
                back[k] = b / b.sum()
            good = (ahead * back)[:, 1] / (ahead * back).sum(1)
            score = float(good @ sizes / sum(sizes))
        assert abs(found[r.doc_id].score - score) < 1e-6 and found[r.doc_id].predicted == (found[r.doc_id].score >= 0.3)


def test_documents_and_labels_weigh_the_same():
    y, first = np.array([1, 1, 1, 1, 0, 1, 0]), np.array([0, 4, 5, 6, 6, 7])
    w = quality_crf.weights_of(y, first)
    of_text = [w[a:b].sum() for a, b in zip(first[:-1], first[1:])]
    assert np.allclose(of_text, np.array([1, 1, 1, 0, 1]) * of_text[0]) and np.isclose(w[y == 1].sum(), w[y == 0].sum()) and np.isclose(w.mean(), 1)


def test_conflicting_labels(spark):
    """Of several rows of one id the greatest label counts, however often a row is repeated."""
    docs = spark.createDataFrame([(k, f"line {k}.\nand more words {k % 3}") for k in range(30)], "doc_id long, text string")
    once = [(k, k % 2) for k in range(30)]
    one, many = (quality_crf.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (once, once * 3 + [(1, 0), (3, None), (5, 7)]))
    assert np.allclose(one.weights, many.weights)


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op1_quality_crf"](spark, FOLDER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.93
    assert np.mean([p for p, q in held if q == 1]) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good line here.\nand more", 1.0), (2, None, 2.0), (3, "", 3.0), (None, " \n\n ", 4.0), (5, "a " * 20000, 5.0), (5, "a " * 20000, 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (5, 0), (2, 0), (9, None)], "doc_id long, quality int")
    field = quality_crf.train(docs, labels)
    found = quality_crf.score(docs, field).collect()
    assert [len(r.line_good) for r in found] == [2, 0, 0, 0, 1, 1] and found[4].score == found[5].score and found[1].score == 0
    assert quality_crf.train(docs, labels.limit(0)) is None and quality_crf.train(docs.limit(0), labels) is None
    assert {r.score for r in quality_crf.score(docs, None).collect()} == {0.5}
    assert quality_crf.score(docs.limit(0), field).count() == 0


def test_counts(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \n\t#é!A1") for _ in range(rnd.randint(0, 30))) for _ in range(400)] + [None, "", "x" * 9000, "a b c " * 3000]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    found = quality_rules.statistics(df).collect()
    assert [[r[c] for c in quality_rules.COUNTS[:5]] for r in found] == [counted(r.text) for r in found]


def test_rules_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = queries.QUERIES["op4_quality_rules"](spark, FOLDER).collect()
    assert {r.doc_id: [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in found} == {i: counted(t) for i, t in texts.items()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in found)
    passed = [(r.kept, labels[r.doc_id]) for r in found if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for k, q in passed if q == 1]) > 0.97 and np.mean([k for k, q in passed if q == 0]) < 0.2


def plain_anomaly(forest, x):
    """The mean path length of one row, tree by tree."""
    total = 0.0
    for column, value, left, right, length in forest.trees:
        k = 0
        while column[k] >= 0:
            k = left[k] if x[column[k]] < value[k] else right[k]
        total += length[k]
    n = forest.rows
    return 2 ** (-total / len(forest.trees) / (2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n))


def test_verdict_against_plain_version(spark):
    """The forest's paths, the threshold of least cost and the verdict, worked out row by row."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stats = quality_rules.statistics(spark.read.parquet(f"{folder}/documents.parquet"))
    forest = quality_rules.fit(stats, labels.where("quality = 1"))
    rows = {r.doc_id: r for r in stats.collect()}
    anomaly = {i: plain_anomaly(forest, quality_rules.shares(np.array([[r[c] for c in quality_rules.COUNTS]]))[0]) for i, r in rows.items()}
    failed = {i: r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words for i, r in rows.items()}
    known = [(math.floor(anomaly[r.doc_id] * quality_rules.BINS), r.quality) for r in labels.collect() if r.doc_id in rows and not failed[r.doc_id] and r.quality is not None]
    cost = [sum(quality_rules.GOOD_WEIGHT * (q == 1 and b > k) + (q == 0 and b <= k) for b, q in known) for k in range(quality_rules.BINS + 2)]
    best = [k for k, c in enumerate(cost) if c == min(cost)]
    limit = (best[len(best) // 2] + 1) / quality_rules.BINS
    found = {r.doc_id: r for r in queries.QUERIES["op4_quality_rules"](spark, folder).collect()}
    assert all(abs(found[i].anomaly - anomaly[i]) < 1e-9 and found[i].kept == (not failed[i] and anomaly[i] < limit) for i in rows)


def test_base_columns_against_sql(spark):
    """The base columns by DuckDB over the whole table; the verdict has no SQL form."""
    import duckdb

    w = r"[^\x20\x09-\x0D]+"
    found = duckdb.sql(f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{w}') AS w FROM '{FOLDER}/documents.parquet'),
    i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1 AS again FROM i),
    r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE again) GROUP BY 1),
    l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{w}') GROUP BY 1)
    SELECT d.doc_id, len(w), coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT, len(regexp_extract_all(t, '[#*$%&|<>]')), coalesce(l.n, 0), coalesce(r.n, 0),
    len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)""").fetchall()
    own = queries.QUERIES["op4_quality_rules"](spark, FOLDER).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(found) == sorted(map(tuple, own))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    counts = queries.QUERIES["quality_rule_counts"](spark, FOLDER).collect()
    assert sorted(duckdb.sql(queries.ORACLE_SQL["quality_rule_counts"]).fetchall()) == sorted(map(tuple, counts)) == sorted(found)


def test_rules_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 2)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, quality int")
    assert [(r.n_words, r.base_failed, r.kept) for r in quality_rules.judge(docs, labels).orderBy("n_words").collect()] == [(0, True, False), (2, True, False), (2, True, False)]
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_labels_of_absent_documents_change_nothing(spark):
    """Labels of documents that are missing, null or without a word use up none of the sample."""
    rows = [(k, f"good words stand here {k}\nand more of them" if k % 2 else f"!!! ### {k}\n$$$ click") for k in range(60)] + [(900, None), (901, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(900, 1), (901, 0)], "doc_id long, quality int")
    absent = spark.range(1000, 200_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    few, many = (quality_crf.train(docs, x, per_label=30) for x in (labels, labels.union(absent)))
    assert np.array_equal(few.weights, many.weights) and few.offset == many.offset


def test_blocks_change_nothing():
    """Texts cut into blocks have the marginals, transitions and partition of the whole chain."""
    rng = np.random.default_rng(6)
    for sizes in ([1], [7, 0, 1, 30, 12], [5] * 9, [100, 3], [0, 0, 8]):
        first = np.append(0, np.cumsum(sizes))
        unary, weight, transition = rng.normal(0, 3, first[-1]), rng.random(first[-1]), rng.normal(0, 2, (2, 2))
        whole = quality_crf.chain_marginals(unary, transition, first, weight, 1000)
        for block in (1, 2, 4, 7):
            found = quality_crf.chain_marginals(unary, transition, first, weight, block)
            assert np.allclose(found[0], whole[0], atol=1e-12) and np.allclose(found[1], whole[1], atol=1e-10) and math.isclose(found[2], whole[2], rel_tol=1e-10)


def test_a_text_of_many_lines():
    """Half a million lines take seconds, not a turn each."""
    rng = np.random.default_rng(7)
    began = time.time()
    good, _, _ = quality_crf.chain_marginals(rng.normal(0, 3, 500_000), np.array([[1.0, -1.0], [-1.0, 1.0]]), np.array([0, 500_000]))
    assert np.isfinite(good).all() and time.time() - began < 20
