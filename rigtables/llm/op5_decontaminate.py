"""Benchmark decontamination by the q-gram lemma, verified by banded alignment.

A benchmark window of m characters that a text holds with at most k edits shares m + 1 - (k + 1) q
q-grams with it, all on k + 1 neighbouring diagonals (text position less window position). So shared
q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half, bands that reach the bound
are aligned within the band, and what is within the budget counts as found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.llm.common import small_batches, table, written

#: Characters of a q-gram, of a window of a long item and between two windows; share of edits allowed. So any excerpt of
#: WINDOW + STRIDE - 1 characters (about twenty words) holds a whole window, wherever it begins.
Q, WINDOW, STRIDE, EDITS = 8, 80, 40, 0.1
#: Places that are aligned side by side; shared q-grams that are counted at a time.
ALIGNED, HITS = 4096, 1 << 19
#: Benchmark text, in bytes, that each task holds at a time (in about 40 times that memory); larger benchmarks are taken in blocks.
BLOCK_BYTES = 4 << 20
#: Letters and digits are kept, ASCII ones in lower case; runs of anything else become one space.
KEPT = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower-cased text as UTF-8, of whose ASCII only letters and digits count, with single spaces. Characters are its bytes."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(KEPT).split())


def q_grams(text: bytes) -> np.ndarray:
    """Each run of 8 bytes as an unsigned 64-bit integer."""
    n = len(text)
    out, padded = np.empty((n + 7) // 8 * 8, "<u8"), text + bytes(16)
    for k in range(8):
        out[k::8] = np.frombuffer(padded, "<u8", len(out) // 8, k)
    return out[: max(0, n - Q + 1)]


def windows(text: bytes) -> list[bytes]:
    """An item whole, or if it is long, windows that cover it."""
    if len(text) <= WINDOW + STRIDE:
        return [text]
    starts = [*range(0, len(text) - WINDOW, STRIDE), len(text) - WINDOW]
    return [text[s : s + WINDOW] for s in starts]


def budget(m: int) -> int:
    """Edits allowed in m characters: a tenth, or as many as leave one shared q-gram."""
    return min(int(EDITS * m), (m + 1) // Q - 1)


class Index:
    """Q-grams of benchmark windows, with the places they come from; and items too short for one, by their text."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        short = [(item, plain(text)) for item, text in items if len(plain(text)) < Q]
        self.short: dict[bytes, list[int | None]] = {}
        for item, text in short:
            if text:
                self.short.setdefault(text, []).append(item)
        found = [(item, w) for item, text in items for w in windows(plain(text)) if len(w) >= Q]
        self.items = [f[0] for f in found]
        self.texts = [np.frombuffer(f[1], np.uint8) for f in found]
        self.length = m = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(x) for x in m.tolist()], np.int64)
        self.least = m + 1 - (self.edits + 1) * Q
        grams = [q_grams(f[1]) for f in found]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        by = np.argsort(every, kind="stable")
        self.window = np.repeat(np.arange(len(found), dtype=np.int32), [len(g) for g in grams])[by]
        self.offset = np.concatenate([np.arange(len(g), dtype=np.int16) for g in grams])[by] if grams else np.zeros(0, np.int16)
        self.grams, self.count = np.unique(every, return_counts=True)
        self.first = np.cumsum(self.count) - self.count
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def bands(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(window, band) wherever enough q-grams meet.

        The text is taken in slices with about HITS shared q-grams each, which overlap by the longest stretch that a
        window can match, so that whatever a band needs lies in one slice.
        """
        grams = q_grams(text)
        (at,) = self.seen[self._slot(grams)].nonzero()
        k = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        hit = self.grams[k] == grams[at]
        at, k = at[hit], k[hit]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach = int(self.length.max() + 2 * (self.edits.max() + 1))
        ends, parts, i = np.cumsum(self.count[k]), [], 0
        while True:
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, side="right"))
            j = max(j, int(np.searchsorted(at, at[i] + 2 * reach)))
            parts.append(self._counted(at[i:j], k[i:j]))
            if j >= len(at):
                break
            i = int(np.searchsorted(at, at[j] - reach))
        key = np.unique(np.concatenate(parts))
        return key >> 40, (key & ((1 << 40) - 1)) - (1 << 39)

    def _counted(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Bands, as window << 40 | band, that reach their bound by the q-grams k at the places `at`."""
        n = self.count[k]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)
        w = self.window[each].astype(np.int64)
        step = self.edits[w] + 1
        band = (np.repeat(at, n) - self.offset[each]) // step
        key, counts = np.unique(w << 40 | band + (1 << 39), return_counts=True)
        key, lower = np.concatenate([key, key - 1]), np.concatenate([counts, counts])  # a band is two steps wide
        key, of = np.unique(key, return_inverse=True)
        counts = np.bincount(of, lower).astype(np.int64)
        return key[counts >= self.least[key >> 40]]

    def found(self, texts: list[bytes]) -> list[list[tuple[int | None, int, int]]]:
        """For each plain text (item, window, edits) of each window that it holds within its budget; short items have window -1."""
        out: list[list[tuple[int | None, int, int]]] = [[(item, -1, 0) for item in self.short.get(t, [])] for t in texts]
        if not len(self.grams):
            return out
        where = [(t, *self.bands(text)) for t, text in enumerate(texts) if len(text) >= Q]
        doc = np.concatenate([np.full(len(w), t) for t, w, _ in where]) if where else np.zeros(0, np.int64)
        window, band = (np.concatenate([x[k] for x in where]) if where else np.zeros(0, np.int64) for k in (1, 2))
        width = 2 * (self.edits[window] + 1)
        order = np.lexsort((width, self.length[window]))  # alike ones together
        best: dict[tuple[int, int], int] = {}
        for i in range(0, len(order), ALIGNED):
            some = order[i : i + ALIGNED]
            w = window[some]
            edits = aligned([self.texts[k] for k in w.tolist()], [texts[k] for k in doc[some].tolist()], band[some] * (self.edits[w] + 1), width[some])
            for d, k, e in zip(doc[some].tolist(), w.tolist(), edits.tolist(), strict=True):
                if e <= self.edits[k]:
                    best[d, k] = min(e, best.get((d, k), e))
        for (d, k), e in sorted(best.items()):
            out[d].append((self.items[k], k, e))
        return out


def aligned(patterns: list[np.ndarray], texts: list[bytes], low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Fewest edits between each pattern and any stretch of its text on diagonals low .. low + width - 1; all pairs side by side."""
    m, n = np.array([len(p) for p in patterns]), np.array([len(t) for t in texts])
    wide, long, far = int(width.max()), int(m.max()), 1 << 20
    pattern, around = np.zeros((len(m), long), np.uint8), np.zeros((len(m), wide + long), np.uint8)  # no plain text holds a 0
    for k, (p, text, d) in enumerate(zip(patterns, texts, low.tolist(), strict=True)):
        pattern[k, : len(p)] = p
        begin, end = max(0, d), max(0, min(len(text), d + wide + len(p)))
        around[k, begin - d : end - d] = np.frombuffer(text, np.uint8)[begin:end]
    shift = np.arange(wide)
    at = low[:, None] + shift
    inside = shift < width[:, None]
    cost = np.where((at >= 0) & (at <= n[:, None]) & inside, 0, far)  # a stretch may begin anywhere
    out = np.full(len(m), far)
    up = np.full_like(cost, far)
    for i in range(long):
        text = around[:, i : i + wide]
        up[:, :-1] = cost[:, 1:] + 1
        new = np.minimum(np.where(text == 0, far, cost + (text != pattern[:, i : i + 1])), up)
        new[~inside] = far
        cost = np.minimum.accumulate(new - shift, axis=1) + shift  # letters of the text left over
        last = m == i + 1
        if last.any():
            out[last] = np.where(inside[last], cost[last], far).min(axis=1)
    return out


def indexes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """The benchmark's windows, broadcast in blocks of about block_bytes of text each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(Index(sorted(((r[0], r[1]) for r in some), key=lambda x: (x[0] is None, x[0] or 0, x[1]))))


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, windows, edits) for each row of docs (doc_id, text) and item (item_id, text) that it holds.

    `windows` counts the item's windows that are found, `edits` is the fewest edits of one. An item of up to
    WINDOW + STRIDE characters is one window. Null and empty texts hold nothing, and nothing holds a null or
    empty item; an item of under 8 plain characters, which any text might hold by chance, is found where
    it is the whole text. Items without an item_id are found like any other. Repeated rows of docs are reported as often as they come; equal items under several
    ids are found under each. Empty tables give no rows; other columns are ignored. The benchmark is
    taken in blocks of a bounded size, each against all of docs.
    """
    small_batches(docs.sparkSession)
    out = None
    for index in indexes(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for doc, found in zip(b.column(0).to_pylist(), index.value.found([plain(t) for t in b.column(1).to_pylist()]), strict=True):
                    each: dict[int | None, list[int]] = {}
                    for item, _, edits in found:
                        each.setdefault(item, []).append(edits)
                    rows += [(doc, item, len(e), min(e)) for item, e in each.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["doc_id", "item_id", "windows", "edits"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, windows long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item; nothing is shuffled.

    Null and empty texts stay, repeated rows stay or go together. What is left is written between two blocks
    of a large benchmark, so that no task holds two.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    for k, index in enumerate(indexes(benchmark, block_bytes)):
        docs = written(docs, "decontaminated") if k else docs

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not f for f in index.value.found([plain(t) for t in b.column(place).to_pylist()])], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
