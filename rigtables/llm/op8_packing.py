"""Packing along a space-filling curve: similar documents share sequences, with next to no padding.

Each document's token ids are hashed to a vector, the vector is projected to a few dimensions, and
documents are range-sorted by the Hilbert key of the projection. The sorted stream is cut every
`length` tokens, so only the very last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.llm.common import in_order, table, written
from rigtables.llm.tokens import cut_up, flat, id_kind, token_ids, vocabulary_size

BUCKETS, DIMENSIONS, DEPTH = 512, 4, 12


def hilbert_key(points: np.ndarray, depth: int) -> np.ndarray:
    """Place of each point on the Hilbert curve; points[:, d] are integers of `depth` bits.

    Gray-code the cube's corners bit plane by bit plane, undoing the turns of the coarser planes.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(depth - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            set_ = (x[d] >> bit & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(depth - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> bit & 1)
    return key


def curve_keys(sizes: np.ndarray, ids: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """Hilbert keys of documents with `sizes` ids each: hashed counts (square roots, unit length), projected and cut to cells.

    A projection of a unit vector by orthonormal rows lies in [-1, 1]; with BUCKETS dimensions
    most lie within 4 / sqrt(BUCKETS) of the axis, which the cells spread over.
    """
    rows = np.linalg.qr(np.random.default_rng(8).standard_normal((BUCKETS, DIMENSIONS)))[0]
    centre = rows.sum(axis=0) / np.sqrt(BUCKETS)
    vectors, ends = np.zeros((len(sizes), BUCKETS), np.float32), np.cumsum(sizes)
    for i in range(0, len(ids), step):
        some = ids[i : i + step]
        first = int(np.searchsorted(ends, i, side="right"))
        last = int(np.searchsorted(ends, i + len(some) - 1, side="right"))
        own = np.minimum(ends[first : last + 1], i + len(some)) - np.maximum(ends[first : last + 1] - sizes[first : last + 1], i)
        slot = np.repeat(np.arange(last + 1 - first), own) * BUCKETS + ((some.astype(np.uint32) * np.uint32(2654435761)) >> 23)
        vectors[first : last + 1] += np.bincount(slot, minlength=(last + 1 - first) * BUCKETS).reshape(-1, BUCKETS)
    vectors = np.sqrt(vectors)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    cells = ((vectors @ rows - centre * 0.5) * np.sqrt(BUCKETS) / 16 + 0.5) * (1 << DEPTH)
    return hilbert_key(np.clip(cells, 0, (1 << DEPTH) - 1).astype(np.int64), DEPTH)


def pack(docs: DataFrame, length: int = 1024, path: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all rows of docs (doc_id, text).

    ids are little-endian unsigned 32-bit integers. Each document ends with id 0; a null or empty text
    is that id alone. Documents cross from one sequence to the next where it is full; every id lies in
    exactly one piece. Equal keys are ordered by doc_id; repeated rows are packed as often as they come.
    No rows give no pieces; other columns are ignored. Only the last sequence may be shorter than `length`.
    """
    kind = id_kind(vocabulary_size(path))
    ordered = in_order(written(token_ids(docs, curve_keys, path), "ids"), ["key", "doc_id"], "n_tokens", "ordered", np.dtype(kind).itemsize)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, at = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            first, last = at // length, (at + size - 1) // length
            n = last - first + 1
            row = np.repeat(np.arange(len(size)), n)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.maximum(sequence * length, at[row])
            end = np.minimum((sequence + 1) * length, at[row] + size[row])
            start = begin - at[row]
            ids = cut_up(end - begin, flat(b.column(3), kind).astype("<u4"))  # pieces follow each other as the ids do
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0).take(pa.array(row)), "start": start, "length": end - begin, "doc_tokens": size[row],
                "sequence_id": sequence, "offset": begin - sequence * length, "ids": ids,
            })

    out = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return ordered.select("doc_id", "n_tokens", "start", "ids").mapInArrow(cut, out)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
