"""Documents dealt into batches of bounded size, and blobs that batches and hash buckets exchange.

Work on all word windows of a corpus would shuffle a row for each of them. Instead, a batch of documents sends each
hash bucket one packed array, and the bucket answers the batch with another. A batch sends a hash once however often it
holds it, so a passage that a third of all documents share costs a bucket one entry a batch.

The rows exchanged are (batches) x (buckets). Batches and buckets both grow with the square root of the input, so their
product grows with the input itself, until both reach the most that a worker should hold (at about 1 TB of text).
Beyond, rows grow faster but get smaller: at 100 TB a row still packs some hundreds of hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.textblock import slices

#: Text in a batch and in a bucket at ``BASE_BYTES`` of input, and the most of each.
BASE_BYTES = 512 << 20
BATCH_BYTES, MOST_BATCH_BYTES = 3 << 20, 192 << 20
BUCKET_BYTES, MOST_BUCKET_BYTES = 12 << 20, 768 << 20
KEY = "batch"
#: Stands for a null id, which comes before all others.
NULL_ID = np.iinfo(np.int64).min


class Sizes:
    """Batches, buckets and bytes of a batch for an input of so many bytes of text."""

    def __init__(self, total: int):
        scale = math.sqrt(max(1, total) / BASE_BYTES)
        self.batch_bytes = int(min(MOST_BATCH_BYTES, max(BATCH_BYTES >> 4, BATCH_BYTES * scale)))
        self.batches = max(1, -(-total // self.batch_bytes))
        self.buckets = max(1, round(total / min(MOST_BUCKET_BYTES, max(BUCKET_BYTES >> 4, BUCKET_BYTES * scale))))


def sizes(docs: DataFrame, text: str = "text") -> Sizes:
    return Sizes(docs.agg(F.sum(F.octet_length(text) + F.lit(64)).cast("long")).first()[0] or 0)


def rows_of(docs: DataFrame, text: str, *more) -> DataFrame:
    """(row, text, more): the other columns as one struct, so that no name of theirs can clash with a helper's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"), *more)


def dealt(docs: DataFrame, batches: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, text, id, tie, batch). tie: a hash of the text, by which rows of one id are ordered and dealt, so that null
    or repeated ids don't crowd one batch; rows that are equal in both share one."""
    keyed = rows_of(docs, text, F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("tie"))
    return keyed.withColumn(KEY, F.pmod(F.xxhash64("id", "tie"), F.lit(batches)).cast("int"))


def in_order(table: pa.Table) -> pa.Table:
    """A batch in the order of ids, null first; rows of one id by the hash of their texts, then by text."""
    pa.default_memory_pool().release_unused()  # what the task's last batch left
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("tie", "ascending"), ("text", "ascending")], null_placement="at_start")).combine_chunks()


def ids_of(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table.column("id"), int(NULL_ID)).combine_chunks().to_numpy(zero_copy_only=False)


def gathered(batches, column: str, limit: int):
    """A task's Arrow batches put together to tables of about ``limit`` bytes of text, longer texts alone."""
    held, size = [], 0
    for piece in slices(batches, column, limit):
        held.append(piece)
        size += piece.column(piece.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def packed(values: np.ndarray) -> bytes:
    """Ascending whole numbers as differences, byte plane by byte plane: planes of zeros compress to nothing."""
    return planes(np.diff(values.astype(np.int64), prepend=0))


def unpacked(blob) -> np.ndarray:
    return np.cumsum(from_planes(blob))


def planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte plane by byte plane."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(blob) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def numbers(values: np.ndarray) -> bytes:
    """Whole numbers below 2^63, a row of columns each, in as few byte planes as the largest needs."""
    flat = np.ascontiguousarray(values.T, np.int64).ravel()
    width = max(1, -(-int(flat.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_numbers(blob, columns: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    width = int(raw[0])
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = raw[1:].reshape(width, -1).T
    return out.view(np.int64).reshape(columns, -1).T


def blobs(column) -> list:
    """Buffers of a binary Arrow column."""
    return [x.as_buffer() for x in column]


def by_bucket(bucket: np.ndarray, buckets: int):
    """(bucket, places) of each bucket that has some, in ascending order; places keep their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(int(b), order[edges[b] : edges[b + 1]]) for b in np.flatnonzero(np.diff(edges))]


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], _KINDS[kind]) for k, (name, kind) in enumerate(fields)})
