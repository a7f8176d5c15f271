"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Two fingerprints that differ in at most `tau` bits differ, in at least one of m groups of bits,
by at most that group's threshold, if the thresholds add up to tau - m + 1. Correlated bits share
a group; each fingerprint gets thresholds of its own by dynamic programming over estimated
candidate counts, probes the groups within them, and every candidate is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.llm.common import connected_components, kept, small_batches, table

BITS, SEED = 64, 42
#: [byte, bit]: the bits of each byte, the lowest first.
BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    at = hashes.view(np.uint8).reshape(-1, 8) + 256 * np.arange(8)
    return (np.bincount(at.ravel(), minlength=8 * 256).reshape(8, 256) @ BYTES).ravel().astype(np.int64)


def majority(ones: np.ndarray, n: int) -> np.int64:
    """The fingerprint of n hashes with these counts: bits that more than half have."""
    return np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]


def fingerprint(text: str | None, words: int = 3, step: int = 1 << 18) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; no word gives 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, step):  # long texts: a bounded number of hashes at a time
        part = w[i : min(i + step, n) + words - 1]
        shingles = zip(*(part[k:] for k in range(words)), strict=False) if len(w) >= words else [w]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], "<u8")
        ones += bit_counts(h)
    return int(majority(ones, n).view("<u8"))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long): the 64 bits of each document as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits, correlated bits together. both[i, j]: fingerprints in which i and j are set."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(left, key=lambda i: corr[i, left].max())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda i: corr[i, group].mean()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _value(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


def _near(hist: np.ndarray, width: int, most: int) -> np.ndarray:
    """[d, v]: entries of hist at exactly d bits from v."""
    at = np.arange(1 << width)
    return np.stack([sum((hist[at ^ sum(1 << i for i in c)] for c in combinations(range(width), d)), np.zeros(1 << width)) for d in range(most + 1)])


def allocate(estimates: np.ndarray, widths: list[int], tau: int, probe_cost: float = 1.0) -> np.ndarray:
    """Thresholds [fingerprint, group] of least cost that add up to tau - m + 1, by dynamic programming.

    estimates[fingerprint, group, t]: candidates expected within t bits; threshold -1 skips a group.
    A probed value costs probe_cost candidates.
    """
    n, m, reach = estimates.shape
    signatures = [np.cumsum([len(list(combinations(range(w), d))) for d in range(reach)]) for w in widths]
    cost = np.concatenate([np.zeros((n, m, 1)), estimates + probe_cost * np.stack(signatures)], axis=2)
    goal = tau + 1  # thresholds plus one each: they add up to tau + 1
    best = np.full((n, goal + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((m, n, goal + 1), np.int64)
    for g in range(m):
        new = np.full((n, goal + 1), np.inf)
        for s in range(goal + 1):
            for t in range(min(s, reach) + 1):
                c = best[:, s - t] + cost[:, g, t]
                better = c < new[:, s]
                new[better, s], took[g, better, s] = c[better], t
        best = new
    out, s = np.zeros((n, m), np.int64), np.full(n, goal)
    for g in reversed(range(m)):
        out[:, g] = took[g, np.arange(n), s] - 1
        s -= out[:, g] + 1
    return out


def groups_for(n: int, tau: int) -> int:
    """How many groups of bits make probes and expected candidates of n even fingerprints the fewest; groups have 32 bits at most."""

    def cost(m: int) -> float:
        spare, out = tau - m + 1, 0.0
        for g in range(m):
            width, reach = BITS // m + (g < BITS % m), spare // m + (g < spare % m)
            out += sum(comb(width, d) for d in range(reach + 1)) * (1 + n / 2**width)
        return out

    return min(range(2, tau + 2), key=cost)


def links(fps: DataFrame, tau: int = 2, m: int | None = None, crowd: int = 64) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within tau bits; fps has fp and rep, each once.

    A value of a group that over `crowd` fingerprints share is not paired up. Its fingerprints meet at
    the values between them instead: for tau = 2, two are linked if and only if some value is within one
    bit of both, and at most 65 fingerprints are within one bit of a value. So the crowded part is exact
    too and grows with the number of fingerprints, not of their pairs. `m` groups of bits; without it as many
    as suit the number of fingerprints, so that buckets stay small as they grow.
    """
    if tau != 2:
        raise ValueError("values between fingerprints settle crowded buckets for tau = 2 only")
    n = fps.count()
    m = m or groups_for(n, tau)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = _bits(b.column(0).to_numpy()).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel().astype(np.int64)) for x in (i, j, total)], names=["i", "j", "c"])

    both = np.zeros((BITS, BITS))
    for i, j, c in fps.select("fp").mapInArrow(together, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c")).collect():  # 4096 rows
        both[i, j] = c
    groups = bit_groups(both, n, m)
    halves = [h for g in groups for h in (g[: (len(g) + 1) // 2], g[(len(g) + 1) // 2 :])]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(h), np.int64) for h in halves]
        for b in batches:
            x = _bits(b.column(0).to_numpy())
            for k, h in enumerate(halves):
                total[k] += np.bincount(_value(x, h), minlength=1 << len(h))
        for k, t in enumerate(total):
            (v,) = t.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(v), pa.array(t[v])], names=["k", "v", "c"])

    hist = [np.zeros(1 << len(h)) for h in halves]
    found = fps.select("fp").mapInArrow(counts, "k long, v long, c long").groupBy("k", "v").agg(F.sum("c").alias("c")).toArrow()  # at most 4 x 2^16 rows
    half, value, count = (found.column(c).to_numpy() for c in ("k", "v", "c"))
    for k in range(len(hist)):
        hist[k][value[half == k]] = count[half == k]
    near = [_near(h, len(half), tau) for h, half in zip(hist, halves, strict=True)]
    widths = [len(g) for g in groups]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = _bits(fp)
            est = np.zeros((len(fp), m, tau + 1))
            for g in range(m):
                lo, hi = (near[2 * g + s][:, _value(x, halves[2 * g + s])] for s in (0, 1))
                exact = [sum(lo[d] * hi[e - d] for d in range(e + 1)) / max(n, 1) for e in range(tau + 1)]
                est[:, g] = np.cumsum(exact, axis=0).T  # the halves taken as independent
            t = allocate(est, widths, tau)
            out = []
            for g, group in enumerate(groups):
                v = _value(x, group)
                out.append((np.full(len(v), g), v, fp, rep, np.zeros(len(v), bool)))
                for d in range(tau + 1):
                    (who,) = (t[:, g] >= d).nonzero()
                    for flips in combinations(range(len(group)), d):
                        if len(who):
                            mask = sum(1 << i for i in flips)
                            out.append((np.full(len(who), g), v[who] ^ mask, fp[who], rep[who], np.ones(len(who), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["grp", "v", "fp", "rep", "probe"])

    entries = kept(fps.select("fp", "rep").mapInArrow(probes, "grp long, v long, fp long, rep long, probe boolean"))
    crowded = kept(entries.where("NOT probe").groupBy("grp", "v").count().where(F.col("count") > crowd).select("grp", "v"))
    sparse = entries.join(crowded, ["grp", "v"], "left_anti")
    q, x = sparse.where("probe"), sparse.where("NOT probe").select("grp", "v", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    near_pairs = (
        q.join(x, ["grp", "v"])
        .where((F.col("fp") != F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= tau))
        .selectExpr("greatest(rep, rep2) AS a", "least(rep, rep2) AS b")
    )
    masks = F.array(F.lit(0), *(F.lit(int(np.uint64(1 << i).view(np.int64))) for i in range(BITS))).cast("array<long>")
    meet = (
        entries.join(crowded, ["grp", "v"], "left_semi")
        .select("fp", "rep")
        .distinct()
        .select("rep", F.explode(F.transform(masks, lambda k: F.col("fp").bitwiseXOR(k))).alias("between"))
        .groupBy("between")
        .agg(F.min("rep").alias("b"), F.collect_list("rep").alias("all"))  # at most 65
        .select(F.explode("all").alias("a"), "b")
    )
    return near_pairs.unionByName(meet).where("a != b").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, fp long, fingerprint, component_id) for every row of docs (doc_id, text).

    A null or empty text, or one without words, has fingerprint zero and links like any other.
    Exact copies share a fingerprint and are never paired with each other; only distinct fingerprints
    are searched. Repeated rows stay repeated. No rows give no rows; other columns are ignored.
    Rows whose doc_id is null keep a fingerprint; the smallest non-null id names their group.
    """
    prints = kept(fingerprints(docs, words))
    fps = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = links(fps.where("rep IS NOT NULL"), tau)
    groups = connected_components(linked)
    named = fps.join(groups, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
