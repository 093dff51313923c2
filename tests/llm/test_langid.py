import zlib

import numpy as np
import pytest

from cellweave.llm import langid, queries

FOLDER = "/root/testdata/sf0.01"


def test_codewords_differ():
    for n in (1, 2, 4, 9, 20):
        codes = langid.codewords(n)
        apart = [(codes[a] != codes[b]).sum() for a in range(n) for b in range(a)]
        assert len(codes) == n and all(x >= 3 for x in apart)


def test_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = queries.QUERIES["op8_language_id"](spark, FOLDER).collect()
    assert len(found) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in found if r.held_out]) > 0.97


def plain(text, model):
    """Grams counted one by one, a bit's loss at a time; (language, share, ambiguous)."""
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0, False
    half = langid.DIMENSIONS // 2
    x, shift = np.zeros(langid.DIMENSIONS), 32 - (half.bit_length() - 1)
    for size, factor, at in ((2, 0x9E3779B1, 0), (3, 0x85EBCA77, half)):
        grams = [int.from_bytes(bytes(data[k : k + size])) for k in range(len(data) - size + 1)]
        for g in grams:
            x[at + ((g * factor & 0xFFFFFFFF) >> shift)] += 1 / len(grams)
    sides = np.sqrt(x) @ model.weights + model.offsets
    loss = [sum(t * np.logaddexp(0, -c * s) for c, s, t in zip(code, sides, model.trust)) for code in model.codes]
    chance = np.exp(min(loss) - np.array(loss))
    second = sorted(chance)[-2] if len(chance) > 1 else 0.0
    return model.languages[int(np.argmin(loss))], 1 / chance.sum(), 1 / (1 + second) < langid.AMBIGUOUS_BELOW


def test_against_plain_version(spark):
    """The query's own columns, and a text of two languages that is flagged."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("held_out", queries.crc_is(4, 2))
    model = langid.train(docs.where("not held_out"))
    found = {r.doc_id: r for r in queries.QUERIES["op8_language_id"](spark, folder).collect()}
    for r in docs.collect():
        lang, share, ambiguous = plain(r.text, model)
        assert (found[r.doc_id].lang_pred, found[r.doc_id].ambiguous) == (lang, ambiguous) and abs(found[r.doc_id].score - share) < 1e-4


def test_the_bound_holds_for_copies(spark):
    """A text that makes up most rows can't exceed the bound on training rows."""
    seen = []
    fit = langid.Model.fit.__func__
    langid.Model.fit, kept = classmethod(lambda cls, rows: seen.append(rows) or fit(cls, rows)), langid.Model.fit
    try:
        df = spark.createDataFrame([(k, "the very same text", "en") for k in range(400)] + [(1000 + k, f"ein text {k}", "de") for k in range(9)], "doc_id long, text string, lang string")
        langid.train(df, per_language=20)
    finally:
        langid.Model.fit = kept
    assert sorted(x for x, _ in seen[0]) == ["de"] * 9 + ["en"] * 20


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "12 34 --- ☃", "en"), (None, "é", None), (7, "the dog " * 5000, "en"), (7, "the dog " * 5000, "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    model = langid.train(docs)
    found = langid.identify(docs, model).collect()
    assert [r.lang_pred for r in found][:5] == ["en", "de", "und", "und", "und"] and found[5].lang_pred in ("en", "de") and found[6].lang_pred == found[7].lang_pred == "en"
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    assert langid.train(docs.where("lang is null")) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    one = langid.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} == {"en", "und"}


def test_a_language_of_many_null_texts_is_learnt(spark):
    """The sample is sized by the rows it is drawn from: null and letterless texts of a language don't thin it out."""
    german = ["der hund und die katze gehen nicht über die straße " * 3 + str(k) for k in range(40)]
    english = ["the dog and the cat would not walk along this street " * 3 + str(k) for k in range(300)]
    rows = [(k, t, lang) for k, (t, lang) in enumerate([(t, "de") for t in german] + [(t, "en") for t in english])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    void = spark.range(1000, 301_000).selectExpr("id as doc_id", "if(id % 2 = 0, null, '12 -- 3') as text", "'de' as lang")
    model = langid.train(docs.union(void))
    assert model.languages == ["de", "en"]
    assert {(r.lang, r.lang_pred) for r in langid.identify(docs, model).collect()} == {("de", "de"), ("en", "en")}
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, most=1)
