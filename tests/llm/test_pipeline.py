import public_tokenizers
import tiktoken
from test_decontaminate import expected as hits
from test_jaccard_join import expected as groups
from test_substring_dedup import expected as kept

import corpus_pipeline
from cellweave.llm import byte_bpe, langid

FOLDER = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    # The classifier itself is held against a plain version in test_langid.
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    told = {r.doc_id for r in langid.identify(table, langid.train(table)).collect() if r.lang_pred != "und" and not r.ambiguous}
    docs = [(i, t) for i, t in rows.items() if i in told]
    docs = [d for d, g in zip(docs, groups(docs, 5, 80)) if g[0] == g[2]]
    docs = [(i, t if not m else k) for (i, t), (n, m, k) in zip(docs, kept(docs, 20)) if m < n or not m]
    docs = [d for d, (n, h, _) in zip(docs, hits([t for _, t in docs], items, 13)) if not h or 20 * h < n]
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    found = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: list(r.ids) for r in found} == {i: tool.encode_ordinary(t) for i, t in docs}
    assert len(found) == len(docs) < len(rows) and all(r.lossless for r in found)


WORDS = "one two three four five six seven eight nine ten eleven twelve"


def test_language_id_uses_its_prediction(spark):
    english, german = "the cat and the dog went to the old house", "der hund und die katze gingen in das alte haus"
    rows = [(k, f"{english} {k}", "en") for k in range(20)] + [(20 + k, f"{german} {k}", "de") for k in range(20)]
    rows += [(50, "die katze und der hund in das haus", None), (51, english, None), (52, "12 34", "en"), (53, None, "en"), (None, english, None)]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {(r.doc_id, r.text): r.lang for r in corpus_pipeline.language_id(spark, docs, FOLDER).collect()}
    model = langid.train(docs)
    want = {(r.doc_id, r.text): r.lang_pred for r in langid.identify(docs, model).collect() if r.lang_pred != "und" and not r.ambiguous}
    assert found == want and found[(50, rows[40][1])] == "de" and found[(51, english)] == "en" and (52, "12 34") not in found and len(want) >= 40


def test_copies_go_by_row(spark):
    """Ids that repeat or are null: only copies go, and of equal rows one stays."""
    rows = [(1, WORDS), (5, WORDS), (5, "quite another text of many words that nobody else has"), (7, "twice " + WORDS[::-1]), (7, "twice " + WORDS[::-1]), (None, WORDS), (None, "a text without an id"), (None, "a text without an id"), (9, None), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in found) == sorted((i or 0, t or "") for i, t in [rows[0], rows[2], rows[3], rows[6], (9, None), (9, None), (10, "")])


def test_near_copies_between_the_rules(spark):
    """Seven single-word edits of 400 words: five-word shingles at 80 % link them, three-word ones at 90 % don't."""
    base = [f"w{k}" for k in range(400)]
    near = [("other" if k % 57 == 30 else w) for k, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base), "en", "s", 1), (2, " ".join(near), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()] == [1]
    assert [g[2] for g in groups([(1, " ".join(base)), (2, " ".join(near))], 3, 90)] == [1, 2]


def test_later_stages_with_ties_and_long_texts(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("text is not null").orderBy("item_id").first().text
    long = " ".join(f"x{k}" for k in range(200_000))
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"start {passage}"), (1, f"start {passage}"), (None, f"before {passage} after"), (3, long), (4, item), (4, item), (5, f"{item} " + long)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.repeated_passages(spark, docs, FOLDER)
    want = [(i, t if not m else k) for (i, t), (n, m, k) in zip(rows, kept(rows, 20)) if m < n or not m]
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted((i or 0, t) for i, t in want)
    free = corpus_pipeline.benchmark_free(spark, docs, FOLDER).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [d for d, (n, h, _) in zip(rows, hits([t for _, t in rows], items, 13)) if not h or 20 * h < n]
    assert sorted((r.doc_id or 0, r.text) for r in free) == sorted((i or 0, t) for i, t in clean) and len(clean) < len(rows)


def test_stages_keep_the_columns_and_edges(spark):
    rows = [(1, "Hello there", "en", "s", 11), (2, None, "en", "s", 0), (3, "", None, None, 0), (4, "12 34", "en", "s", 5), (None, "Hello there", "en", "s", 11), (6, "hello THERE", "en", "s", 11)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for start in (docs, docs.limit(0)):
        out = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, FOLDER)
            if name != "token_ids":
                assert out.columns == corpus_pipeline.COLUMNS
        assert sorted((r.doc_id or 0) for r in out.collect()) == ([1] if start is docs else [])
