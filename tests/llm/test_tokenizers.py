import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from cellweave.llm import byte_bpe, queries, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = " \n\t  ab'sé1,!  漢😀\x1c\x85▁<|endoftext|>"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    return [*made, "", " ", "  ", "a ", "x" * 3000, "word, " * 2000, "the\0 end\0", "it's  we'll\n\n go"]


def test_codec_matches_the_library(texts):
    ranks = byte_bpe.read_ranks(RANKS)
    own, other = byte_bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = own.encode_all(texts)
    assert found == [other.encode_ordinary(x) for x in texts]
    assert [own.decode(x) for x in found] == [x.encode() for x in texts]
    with pytest.raises(KeyError):
        own.decode([10**7])


def test_counts_match_the_library(texts):
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.Counter(PIECES).count_all(texts) == [len(pieces.encode(x)) for x in texts]


def test_operators_on_frames(spark, texts):
    rows = [(i, x, "c") for i, x in enumerate(texts)] + [(1, None, None), (None, "a b", "c"), (None, "a b", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string")
    ranks = byte_bpe.read_ranks(RANKS)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    back = byte_bpe.decode(found, RANKS, public_tokenizers.PATTERN).collect()
    assert len(back) == len(rows)
    assert sorted((r.text or "", tuple(r.ids), bytes(r.decoded)) for r in back) == sorted((x[1] or "", tuple(other.encode_ordinary(x[1] or "")), (x[1] or "").encode()) for x in rows)
    counted = token_counts.count_tokens(df, PIECES).collect()
    assert len(counted) == len(rows) and all(r.n_tokens == 0 for r in counted if r.text is None)
    with pytest.raises(ValueError):
        token_counts.count_tokens(df.withColumnRenamed("size", "n_tokens"), PIECES)
    empty = df.limit(0)
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == token_counts.count_tokens(empty, PIECES).count() == 0


def test_other_patterns_are_not_divided(texts):
    """A pattern that cuts across spaces, which the shipped one never does."""
    ranks, pattern = byte_bpe.read_ranks(RANKS), r"[a-z]+ [a-z]+|\s+|\S"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert byte_bpe.Codec(ranks, pattern).encode_all(texts) == [other.encode_ordinary(x) for x in texts]


def test_decoding_inverts_the_mapping():
    ranks = byte_bpe.read_ranks(RANKS)
    tool, bytes_of = byte_bpe.Codec(ranks, public_tokenizers.PATTERN), {r: t for t, r in ranks.items()}
    ids = sorted(bytes_of)
    assert tool.decode_all([[i] for i in ids]).to_pylist() == [bytes_of[i] for i in ids]
    assert tool.decode_all([]).to_pylist() == [] and tool.decode_all([[], ids[:300]]).to_pylist() == [b"", b"".join(bytes_of[i] for i in ids[:300])]


def test_caches_hold_no_long_division():
    long = "y" * 500 + " " + "ab" * 300
    for tool, known in ((byte_bpe.Codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN), "encode_all"), (token_counts.Counter(PIECES), "count_all")):
        first = getattr(tool, known)([long, "ab ab " + long])
        assert first == getattr(tool, known)([long, "ab ab " + long]) and max(map(len, tool.known)) <= byte_bpe.CACHE_LENGTH


def test_queries(spark):
    """Every column of the registered queries, hashes too, as the libraries give them."""
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    n = {i: len(pieces.encode(t)) for i, t in rows}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op6_token_counts"](spark, folder).collect()} == {i: (len(t.encode()), n[i], n[i] > 4096) for i, t in rows}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    ids = {i: other.encode_ordinary(t) for i, t in rows}
    want = {i: (len(ids[i]), sha(",".join(map(str, ids[i])).encode()), sha(t.encode())) for i, t in rows}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op7_byte_bpe"](spark, folder).collect()} == want
