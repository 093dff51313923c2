"""Alignment of two tokenizers' tokens through sparse incidence matrices.

A token covers bytes, so each tokenizer gives a matrix of tokens by bytes. Row products of the first with the second's
transpose (Gustavson) give the pairs of tokens that overlap; where neither token goes on, both end, and a group ends with
them. Matrices of tokens by groups, multiplied the same way, give the pairs that share a group: the links.

A text is cut at spaces after other than white space, where both tokenizers cut whatever follows. Each distinct division of a
slice of texts is encoded and aligned once; a text's result is put together from its divisions'.

How many documents hold a pair of ids linked is counted over the corpus: batches of documents send hash buckets of first ids
their distinct pairs, packed, with the number of their documents, and get back the corpus's counts and which are the highest
of their first id. Texts aren't shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.batching import blobs, by_bucket, from_planes, packed, planes, sizes, table_of, unpacked
from cellweave.llm.byte_bpe import byte_characters, divisions
from cellweave.llm.durable import saved
from cellweave.llm.textblock import mix, running, slices

#: Entries of a product that are made at a time, about.
PRODUCT_ENTRIES = 1 << 20
#: Divisions encoded at a time, as the libraries' results are large.
ENCODED_AT_ONCE = 20_000
#: The most text of a batch, whatever the input's size: its pairs are held as numbers, several times the text.
MOST_BATCH_BYTES = 48 << 20
_SENT = "bucket int, batch long, pairs binary, documents binary"
_ANSWER = "batch long, bucket int, counts binary, best binary"


class Csr:
    """A sparse 0/1 matrix by rows: row i holds the columns ``indices[indptr[i]:indptr[i + 1]]``."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray):
        self.indptr, self.indices = indptr, indices


def product(left: Csr, right: Csr, limit: int = PRODUCT_ENTRIES):
    """(rows, columns, counts) of left · right in blocks of rows: each row is the sum of the right rows that its entries name."""
    size = np.diff(right.indptr)[left.indices]
    work = running(size)[left.indptr]
    a, rows = 0, len(left.indptr) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(work, work[a] + limit, side="right")) - 1)
        named, take = left.indices[left.indptr[a] : left.indptr[b]], size[left.indptr[a] : left.indptr[b]]
        row = np.repeat(np.repeat(np.arange(a, b), np.diff(left.indptr[a : b + 1])), take)
        inner = np.arange(len(row)) - np.repeat(running(take)[:-1], take)
        column = right.indices[np.repeat(right.indptr[named], take) + inner]
        if len(row) > 1 and (((row[1:] == row[:-1]) & (column[1:] < column[:-1])).any()):
            order = np.lexsort((column, row))
            row, column = row[order], column[order]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (column[1:] != column[:-1]))[: len(row)])
        yield row[new], column[new], np.diff(np.append(new, len(row)))
        a = b


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each pair of tokens that share a byte, in order; the two lists of sizes cover the same bytes."""
    whole = int(a_sizes.sum())
    tokens = Csr(running(a_sizes), np.arange(whole))
    by_byte = Csr(np.arange(whole + 1), np.repeat(np.arange(len(b_sizes)), b_sizes))
    found = [(r, c) for r, c, _ in product(tokens, by_byte)] or [(np.zeros(0, np.int64),) * 2]
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


def groups_of(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side. A group ends where the next overlap has another token on both sides."""
    a, b = overlaps(a_sizes, b_sizes)
    group = np.cumsum(np.append(False, (a[1:] != a[:-1]) & (b[1:] != b[:-1]))[: len(a)])
    of_a, of_b = np.zeros(len(a_sizes), np.int64), np.zeros(len(b_sizes), np.int64)
    of_a[a], of_b[b] = group, group
    return of_a, of_b


def links(of_a: np.ndarray, of_b: np.ndarray):
    """(a, b) of the pairs of tokens that share a group, in blocks."""
    n = int(max(of_a[-1], of_b[-1])) + 1 if len(of_a) else 0
    in_groups = Csr(np.arange(len(of_a) + 1), of_a)
    members = Csr(np.searchsorted(of_b, np.arange(n + 1)), np.arange(len(of_b)))
    for a, b, _ in product(in_groups, members):
        yield a, b


class Divisions:
    """The aligned divisions of a slice of texts, by columns: ``counts`` (n_a, n_b, n_groups, n_links), ``bad`` where the tokens' bytes
    aren't the division's, ``shown`` (the groups' text, each group ended by a semicolon), and distinct pairs ``keys`` with their
    links ``times``, from ``at`` to the next."""

    def __init__(self, counts: np.ndarray, bad: np.ndarray, shown: list[str], keys: np.ndarray, times: np.ndarray, at: np.ndarray):
        self.counts, self.bad, self.shown, self.keys, self.times, self.at = counts, bad, shown, keys, times, at


class Aligner:
    """Two tokenizers, and what their tokens stand for."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = p = sentencepiece.SentencePieceProcessor(model_file=second)
        byte_of = {c: k for k, c in enumerate(byte_characters())}
        with open(first, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if all(c in byte_of for c in token):
                a_bytes[k] = bytes(map(byte_of.__getitem__, token))
        self.a_bytes = a_bytes
        self.b_bytes = [bytes([int(p.id_to_piece(k)[3:-1], 16)]) if p.is_byte(k) else p.id_to_piece(k).replace("▁", " ").encode() for k in range(p.get_piece_size())]
        self.a_total, self.b_total = len(self.a_bytes), len(self.b_bytes)
        if self.a_total * self.b_total >= 1 << 32:
            raise ValueError("a pair of ids of these vocabularies doesn't fit 32 bits")
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.lone = len(p.encode("a"))
        # Each id's text within a group, and at the end of its side of one.
        self.text = np.array([f"{k}{end}" for n, ends in ((self.a_total, ",|"), (self.b_total, ",;")) for end in ends for k in range(n)], object)

    def encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first ids, their number in each division, second ids, their number), some divisions at a time."""
        a, b, n_a, n_b = [], [], [], []
        for k in range(0, len(parts), ENCODED_AT_ONCE):
            some = parts[k : k + ENCODED_AT_ONCE]
            a_ids = [x.ids for x in self.first.encode_batch_fast(some, add_special_tokens=False)]
            # The space that a division begins with is the one that the model puts before a text; spaces alone follow a letter here.
            blank = [not x.strip(" ") for x in some]
            b_ids = self.second.encode(["a" + x if alone else x[1:] for x, alone in zip(some, blank)], num_threads=1)
            b_ids = [ids[self.lone :] if alone else ids for ids, alone in zip(b_ids, blank)] if any(blank) else b_ids
            for out, n, ids in ((a, n_a, a_ids), (b, n_b, b_ids)):
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                out.append(np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum())))
                n.append(size)
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, n_a, b, n_b))

    def divisions(self, parts: list[str]) -> Divisions:
        """Alignments of distinct divisions, none of them empty."""
        a, n_a, b, n_b = self.encoded(parts)
        raw = [x.encode() for x in parts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sums = lambda ids, n, sizes: np.diff(running(sizes[ids])[running(n)])
        bad = (sums(a, n_a, self.a_size) != size) | (sums(b, n_b, self.b_size) != size)
        whole = b"".join(raw)
        if bad.any() or any(b"".join(map(table.__getitem__, ids.tolist())) != whole for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            for k, (i, j, u, v, text) in enumerate(zip(running(n_a), running(n_a)[1:], running(n_b), running(n_b)[1:], raw)):
                bad[k] = not b"".join(map(self.a_bytes.__getitem__, a[i:j].tolist())) == text == b"".join(map(self.b_bytes.__getitem__, b[u:v].tolist()))
            a, b = a[np.repeat(~bad, n_a)], b[np.repeat(~bad, n_b)]
            n_a, n_b = np.where(bad, 0, n_a), np.where(bad, 0, n_b)
        of_a, of_b = groups_of(self.a_size[a], self.b_size[b])
        # Divisions end where tokens of both sides do, so no group crosses two.
        a_at, b_at = running(n_a), running(n_b)
        groups = int(of_a[-1]) + 1 if len(of_a) else 0
        g_at = np.append(of_a, groups)[a_at]
        a_end, b_end = np.append(of_a[1:] != of_a[:-1], True)[: len(a)], np.append(of_b[1:] != of_b[:-1], True)[: len(b)]
        # The texts of all tokens, a group's first ones before its second ones.
        place = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        pieces = self.text[np.concatenate([a + self.a_total * a_end, b + 2 * self.a_total + self.b_total * b_end])[place]].tolist()
        ends = (a_at + b_at).tolist()
        shown = ["".join(pieces[i:j]) for i, j in zip(ends, ends[1:])]
        division = np.repeat(np.arange(len(parts), dtype=np.uint64), n_a)
        keys, times, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in links(of_a, of_b):
            found, n = np.unique(division[x] << np.uint64(32) | (a[x] * self.b_total + b[y]).astype(np.uint64), return_counts=True)
            owner.append((found >> np.uint64(32)).astype(np.int64))
            keys.append(found & np.uint64(0xFFFFFFFF))
            times.append(n)
        # A block of links ends with a row, so a pair of a division may stand in two; they are added up with the text's.
        keys, times, owner = np.concatenate(keys), np.concatenate(times), np.concatenate(owner)
        at = np.searchsorted(owner, np.arange(len(parts) + 1))
        counts = np.stack([n_a, n_b, np.diff(g_at), np.diff(running(times)[at])], axis=1)
        return Divisions(counts, bad, shown, keys, times, at)

    def align(self, texts: list) -> tuple[np.ndarray, list, list, list]:
        """(texts x n_a, n_b, n_groups, n_links; pieces of each text's groups, or None without tokens; each text's distinct
        pairs, ascending; their links)."""
        rows = [divisions(" " + x) if x else [] for x in texts]
        place: dict[str, int] = {}
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((place.setdefault(x, len(place)) for x in chain.from_iterable(rows)), np.int64, int(size.sum()))
        del rows
        held, first = self.divisions(list(place)), running(size)
        lost = running(held.bad[flat])
        lost = lost[first[1:]] > lost[first[:-1]]
        sums = np.zeros((len(flat) + 1, 4), np.int64)
        np.cumsum(held.counts[flat], axis=0, out=sums[1:])
        counts = sums[first[1:]] - sums[first[:-1]]
        counts[lost] = 0
        shown = held.shown
        pieces = [None if gone or a == b else [shown[k] for k in flat[a:b].tolist()] for gone, a, b in zip(lost, first[:-1], first[1:])]
        owner = np.repeat(np.arange(len(texts)), size)
        use = ~lost[owner]
        kinds = max(1, len(shown))
        cell, times = np.unique(owner[use] * kinds + flat[use], return_counts=True)
        which, owner = cell % kinds, cell // kinds
        take = np.diff(held.at)[which]
        inner = np.repeat(held.at[:-1][which] - running(take)[:-1], take) + np.arange(int(take.sum()))
        pair = np.repeat(owner.astype(np.uint64), take) << np.uint64(32) | held.keys[inner]
        weight = held.times[inner] * np.repeat(times, take)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        weight = np.add.reduceat(weight[order], new) if len(new) else weight[:0]
        pair = pair[new]
        edges = np.searchsorted(pair >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
        pair = (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return counts, pieces, [pair[a:b] for a, b in zip(edges, edges[1:])], [weight[a:b] for a, b in zip(edges, edges[1:])]


@functools.lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    """The worker's aligner for two files that every node can read."""
    return Aligner(first, second)


def _digest(pieces: list | None) -> str:
    """SHA-256 of the groups' text, which is never put together; an empty string without tokens."""
    if pieces is None:
        return ""
    found = hashlib.sha256()
    for k in range(0, len(pieces) - 1, 4096):
        found.update("".join(pieces[k : min(k + 4096, len(pieces) - 1)]).encode())
    found.update(pieces[-1][:-1].encode())
    return found.hexdigest()


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, first: str, second: str, text: str = "text", groups: bool = False, batch_bytes: int | None = None, buckets: int | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``first``: a byte-level BPE file of the tokenizers library, which encodes a space and the text; ``second``: a sentencepiece
    model, which adds that space itself; special tokens in a text are plain text to both. The tokens of both are cut into
    groups where both end at one byte. Links: pairs of a first and a second token of one group. n_best: links whose pair of
    ids is linked in as many documents of the corpus as any pair of that first id; count_sum: that number, added up over
    links. groups_sha256: of ``a1,a2|b1;a3|b2,b3``, the ids of each group; ``groups`` adds that text itself.

    A text that is null, empty, or whose bytes the tokens of either side don't give back (as where the model normalises)
    has no tokens: zeros and an empty string. Rows count as documents, also those that are equal. New columns replace those of their names.
    """
    names = [*COUNTS, "groups_sha256", *(["groups"] if groups else [])]
    docs = docs.drop(*names, "n_best", "count_sum")
    size = sizes(docs, text)
    limit, n_buckets = batch_bytes or min(MOST_BATCH_BYTES, size.batch_bytes), buckets or size.buckets
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    keyed = docs.select(F.struct(*others).alias("row"), F.col(text).alias("text"))
    row = T.StructField("row", keyed.schema["row"].dataType)  # null in a batch's own row
    kinds = {"batch": T.LongType(), **{c: T.LongType() for c in COUNTS}, **{c: T.StringType() for c in names[4:]}, **{c: T.BinaryType() for c in ("pairs", "links", "known", "documents")}}
    schema = T.StructType([row, *(T.StructField(c, k) for c, k in kinds.items())])
    found = saved(keyed.mapInArrow(_aligned(first, second, limit, groups, schema.names), schema))
    sent = found.where("known is not null").select("batch", "known", "documents").mapInArrow(_sender(first, second, n_buckets), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_bucket(first, second), _ANSWER)
    out = T.StructType([row, *(T.StructField(c, kinds[c]) for c in names), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    result = found.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_counted(first, second, n_buckets, names), out)
    return result.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != text], *COUNTS, "n_best", "count_sum", *names[4:])


def _aligned(first: str, second: str, limit: int, groups: bool, names: list[str]):
    """A row for each text, and after the rows of a batch one with its distinct pairs and how many of its texts hold each."""

    def run(batches):
        tool, number, size, kinds = aligner(first, second), TaskContext.get().partitionId() << 32, 0, None
        none = (np.zeros(0, np.int64),) * 2
        known, n = none

        def header():
            values = {"batch": number, "known": packed(known), "documents": planes(n)}
            return pa.RecordBatch.from_arrays([pa.array([values.get(c)], kind) for c, kind in zip(names, kinds)], names=names)

        for batch in slices(batches, "text"):
            column = batch.column(batch.schema.get_field_index("text"))
            counts, pieces, pairs, times = tool.align(column.to_pylist())
            new = [pa.array(np.full(batch.num_rows, number)), *(pa.array(counts[:, k]) for k in range(4)), pa.array(map(_digest, pieces), pa.string())]
            if groups:
                new.append(pa.array(("" if x is None else "".join(x)[:-1] for x in pieces), pa.string()))
            new += [pa.array(map(packed, pairs), pa.binary()), pa.array(map(planes, times), pa.binary()), pa.nulls(batch.num_rows, pa.binary()), pa.nulls(batch.num_rows, pa.binary())]
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), *new], names=names)
            kinds = out.schema.types
            yield out
            own, m = np.unique(np.concatenate(pairs), return_counts=True)
            known, which = np.unique(np.concatenate([known, own]), return_inverse=True)
            n = np.bincount(which, np.concatenate([n, m]), len(known)).astype(np.int64)
            size += column.nbytes
            if size >= limit:
                yield header()
                number, size, (known, n) = number + 1, 0, none
        if kinds is not None and size:
            yield header()

    return run


def _buckets_of(pairs: np.ndarray, b_total: int, buckets: int) -> np.ndarray:
    """The bucket of each pair, by its first id."""
    return (mix((pairs // b_total).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _sender(first: str, second: str, buckets: int):
    def run(batches):
        total = aligner(first, second).b_total
        for batch in batches:
            for key, known, documents in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), blobs(batch.column(2))):
                known, documents = unpacked(known), from_planes(documents)
                rows = [(b, key, packed(known[at]), planes(documents[at])) for b, at in by_bucket(_buckets_of(known, total, buckets), buckets)]
                yield from table_of(rows, _SENT).to_batches()

    return run


def _bucket(first: str, second: str):
    """For each batch, the corpus's count of each pair that it sent, and a bit for the highest of a first id."""

    def run(table: pa.Table) -> pa.Table:
        total = aligner(first, second).b_total
        parts = [unpacked(x) for x in blobs(table.column("pairs"))]
        whole, which = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(which, np.concatenate([from_planes(x) for x in blobs(table.column("documents"))])).astype(np.int64)
        owner = whole // total
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = counts == np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(owner))))
        bucket = table.column("bucket")[0].as_py()
        rows = [(key, bucket, counts[at].tobytes(), np.packbits(best[at]).tobytes()) for key, at in zip(table.column("batch").to_pylist(), (np.searchsorted(whole, p) for p in parts))]
        return table_of(rows, _ANSWER)

    return run


def _counted(first: str, second: str, buckets: int, names: list[str]):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        heads = table.column("known").is_valid()
        texts = table.filter(pc.invert(heads))
        known = np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in blobs(table.filter(heads).column("known")))])
        counts, best = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
        places = dict(by_bucket(_buckets_of(known, aligner(first, second).b_total, buckets), buckets))
        for b, found, bits in zip(answers.column("bucket").to_pylist(), blobs(answers.column("counts")), blobs(answers.column("best"))):
            counts[places[b]] = np.frombuffer(found, np.int64)
            best[places[b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(places[b])).astype(bool)
        n_best, count_sum = [], []
        for pairs, times in zip(blobs(texts.column("pairs")), blobs(texts.column("links"))):
            at, times = np.searchsorted(known, unpacked(pairs)), from_planes(times)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int(times @ counts[at]))
        return pa.table([*(texts.column(c) for c in ("row", *names)), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=["row", *names, "n_best", "count_sum"])

    return run
