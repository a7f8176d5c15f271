"""Token ids in a binary format: canonical, length-limited Huffman codes in independent blocks.

Code lengths come from the global counts of ids. A block holds whole documents; every `EVERY` ids it
notes the bit at which the next code begins, so that a table-driven decoder can read all those
stretches side by side, and any stretch alone. The code lengths lie beside the blocks, so the files need
nothing else to be read.

Block, little-endian: b"HUF1", u32 documents, u64 ids, u32 EVERY, u32 padding, i64 doc_id each,
u64 n_ids each, u64 bit offset of each stretch, then the codes, highest bit first.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.durable import fresh_path
from rigtables.llm.common import parts_for, table, totals_before, written
from rigtables.llm.tokens import cut_up, flat, id_kind, token_ids, vocabulary_size

HEAD = struct.Struct("<4sIQII")
LONGEST, EVERY, BLOCK_IDS = 20, 128, 1 << 18
#: Written for a null doc_id.
NO_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol's code (0: not used) by package-merge: least total length within the limit."""
    (used,) = counts.nonzero()
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols need more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages, levels = np.zeros(0, np.int64), []
    for _ in range(longest):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    for leaf in reversed(levels):  # of what is taken, the leaves are the rarest symbols
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= bits - before
        before = bits
        (at,) = (lengths == bits).nonzero()
        codes[at] = code + np.arange(len(at), dtype=np.uint64)
        code += len(at)
    return codes


def encode_block(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One block of documents with `sizes` ids each, `ids` in a row."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    words = np.zeros(int(ends[-1]) // 64 + 2 if len(ends) else 0, np.uint64)
    if len(ids):
        code, word, room = codes[ids], at >> 6, 64 - (at & 63) - bits
        (over,) = (room < 0).nonzero()  # one code at most goes over into each word
        split = code[over]
        code <<= np.maximum(room, 0, out=bits).view(np.uint64)
        code[over] = split >> (-room[over]).astype(np.uint64)
        begin = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[begin]] = np.bitwise_or.reduceat(code, begin)
        words[word[over] + 1] |= split << (64 + room[over]).astype(np.uint64)
    head = HEAD.pack(b"HUF1", len(docs), len(ids), EVERY, 0)
    return b"".join([head, np.asarray(docs, "<i8").tobytes(), np.asarray(sizes, "<u8").tobytes(), at[::EVERY].astype("<u8").tobytes(), words.astype(">u8").tobytes()])


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, bits, width): the code that the next `width` bits begin with."""
    width = max(1, int(lengths.max(initial=0)))
    symbol, bits = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.int64)
    used = np.lexsort((np.arange(len(lengths)), lengths))
    used = used[lengths[used] > 0]
    spans = 1 << (width - lengths[used].astype(np.int64))
    n = int(spans.sum())
    symbol[:n], bits[:n] = np.repeat(used, spans), np.repeat(lengths[used], spans)
    return symbol, bits, width


def decode_block(block: bytes, tables: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids of each, all ids in a row)."""
    symbol, bits, width = tables
    magic, n_docs, n, every, _ = HEAD.unpack_from(block)
    if magic != b"HUF1":
        raise ValueError("not a block of Huffman codes")
    lanes = -(-n // every)
    docs = np.frombuffer(block, "<i8", n_docs, HEAD.size)
    sizes = np.frombuffer(block, "<u8", n_docs, HEAD.size + 8 * n_docs).astype(np.int64)
    at = np.frombuffer(block, "<u8", lanes, HEAD.size + 16 * n_docs).astype(np.int64)
    raw = np.frombuffer(block + bytes(8), np.uint8, offset=HEAD.size + 16 * n_docs + 8 * lanes).astype(np.uint32)
    four = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out, mask = np.zeros((every, lanes), "<u4"), np.uint32((1 << width) - 1)
    for k in range(every):  # all stretches advance by one code
        np.minimum(at, 8 * (len(four) - 1), out=at)  # the last stretch may have ended
        window = four[at >> 3] >> (32 - width - (at & 7)).astype(np.uint32) & mask
        np.take(symbol, window, out=out[k])
        at += bits[window]
    return docs, sizes, out.T.ravel()[:n]


def write_token_files(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Documents (doc_id, text) as Huffman-coded files: `folder`/blocks, and the code lengths in `folder`/codes.

    Texts are sorted by doc_id before they become ids, so the ids are written once and no id is shuffled. A
    block says after how many ids of its part it begins. The counts of ids, one for each entry of the
    vocabulary, are all that reaches the driver.
    """
    spark, vocabulary = docs.sparkSession, vocabulary_size(path)
    kind = id_kind(vocabulary)
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    n = parts_for(spark, named.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    ranged = named.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    made = token_ids(ranged, path=path)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            sizes = b.column(2).to_numpy()
            ends = total + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - sizes)], names=["part", "doc_id", "n_tokens", "ids", "start"])
            total = int(ends[-1]) if len(ends) else total

    ids = written(made.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "n_tokens", "ids").mapInArrow(start, "part long, doc_id long, n_tokens long, ids binary, start long"), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            total += np.bincount(flat(b.column(0), kind), minlength=vocabulary)
        (at,) = total.nonzero()
        yield pa.RecordBatch.from_pydict({"id": at, "n": total[at]})

    counts = np.zeros(vocabulary, np.int64)
    for k, n in ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect():  # one row for each id
        counts[k] = n
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{folder}/codes")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block holds documents of one part that follow each other in one batch."""
        codes = canonical_codes(lengths)
        for b in batches:
            part, doc, sizes, start = (b.column(k).to_numpy() for k in (0, 1, 2, 4))
            every, ends = flat(b.column(3), kind), np.cumsum(sizes)
            begins = ends - sizes
            fresh = np.ones(len(part), bool)
            fresh[1:] = (part[1:] != part[:-1]) | (start[1:] != start[:-1] + sizes[:-1]) | (begins[1:] // BLOCK_IDS != begins[:-1] // BLOCK_IDS)
            first = np.append(fresh.nonzero()[0], len(part))
            for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                data = encode_block(doc[i:j], sizes[i:j], every[begins[i] : ends[j - 1]], lengths, codes)
                yield pa.RecordBatch.from_pydict({"part": part[i : i + 1], "n_ids": sizes[i:j].sum(keepdims=True), "start": start[i : i + 1], "data": pa.array([data], pa.binary())})

    blocks = ids.select("part", "doc_id", "n_tokens", "ids", "start").mapInArrow(encode, "part long, n_ids long, start long, data binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in `folder`; ids little-endian unsigned 32-bit, start the ids of all before."""
    lengths = np.frombuffer(spark.read.schema("lengths binary").parquet(f"{folder}/codes").first()[0], np.uint8)  # one row, a byte for each entry of the vocabulary
    blocks = spark.read.schema("part long, n_ids long, start long, data binary").parquet(f"{folder}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decode_table(lengths)
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs, sizes, ids = decode_block(data, tables)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_pydict({"doc_id": docs, "start": start + ends - sizes, "n_tokens": sizes, "ids": cut_up(sizes, ids)})

    placed = blocks.join(F.broadcast(totals_before(blocks, "n_ids")), "part").select((F.col("start") + F.col("before")).alias("start"), "data")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def huffman_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all rows of docs (doc_id, text), written as files in the shared folder and read back.

    A null or empty text is the end id alone. Repeated doc_ids are written as often as they come, in any
    order among themselves; rows without doc_id come first. No rows give no blocks; other columns are ignored.
    """
    folder = fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, path)
    return read_token_files(docs.sparkSession, folder)


def op10_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = huffman_round_trip(table(spark, sf_dir, "documents"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
