"""Language by rank-order profiles of character n-grams and the out-of-place distance between them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigtables.llm.common import small_batches, table
from rigtables.llm.tokens import lighter

#: N-grams in a profile, and their longest length.
TOP, LONGEST = 300, 3
#: Shares of a language's n-grams among which the most frequent are looked for first.
SHARES = 64
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str | None, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of 1 to 3 characters in words of letters, lower-cased, words padded by one space.

    A code is three characters of 21 bits each; n-grams that go over a space are no part of a word.
    Long texts are counted in steps.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    raw = np.where(_letters()[raw], raw, 32)
    raw = np.concatenate([[32], raw, [32]])
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))]
    for i in range(0, len(raw), step):
        c = raw[max(0, i - 2) : i + step]
        new = min(i, 2)
        one = c[new:]
        two = (c[:-1] << 21 | c[1:])[max(new - 1, 0) :]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[c[1:-1] != 32] if len(c) > 2 else c[:0]
        counted = pc.value_counts(pa.array(np.concatenate([one[one != 32], two, three])))
        found.append(tuple(np.asarray(counted.field(k)) for k in (0, 1)))
    codes = np.concatenate([f[0] for f in found])
    if len(found) == 1:
        return codes, found[0][1]
    codes, at = np.unique(codes, return_inverse=True)
    return codes, np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64)


def profile(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams in order; equally frequent ones by code."""
    if len(codes) > 4 * top:
        most = counts >= np.partition(counts, -top)[-top]
        codes, counts = codes[most], counts[most]
    return codes[np.lexsort((codes, -counts))][:top]


def learn_profiles(docs: DataFrame, top: int = TOP, most: int = 1024) -> dict[str, list[int]]:
    """The n-grams of each language in order of frequency, over all rows of docs (lang, text) with a lang.

    top n-grams for each language reach the driver; more than `most` languages are an error.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighter()
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, some in total.items():
                codes, at = np.unique(np.concatenate([s[0] for s in some]), return_inverse=True)
                n = np.bincount(at, np.concatenate([s[1] for s in some])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes, "n": n})
            total.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = grams(text)
                total.setdefault(lang, []).append(found)
                held += len(found[0])
            if held > 4_000_000:
                yield from out()
                held = 0
        yield from out()

    counted = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), "code"]
    near = counted.withColumn("r", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("code"), F.lit(SHARES))).orderBy(*order))).where(F.col("r") <= top)
    best = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("r") <= top)
    found: dict[str, list[int]] = {}
    for lang, code, _ in sorted(best.select("lang", "code", "r").collect(), key=lambda x: (x[0], x[2])):
        found.setdefault(lang, []).append(code)
    if len(found) > most:
        raise ValueError(f"{len(found)} languages; the limit is {most}")
    return found


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """docs' columns with lang_pred and score (columns of these names are replaced); `text` alone is looked at.

    The distance to a language adds up, over the document's n-grams, how far apart the two ranks are, `top`
    where the language lacks the n-gram. The nearest language wins, the first by name if several are as near.
    score is 1 less the distance by its largest value. Null texts and those without letters are
    `und` with score 0; so is everything if no language was learned.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    langs = sorted(profiles)
    codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
    ranks = np.full((len(codes) + 1, len(langs)), -1, np.int64)
    for k, lang in enumerate(langs):
        ranks[np.searchsorted(codes, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def one(text: str | None) -> tuple[str, float]:
        own = profile(*grams(text), top) if text else codes[:0]
        if not len(own) or not langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(codes, own)
        at[np.append(codes, -1)[at] != own] = len(codes)
        theirs = ranks[at]
        apart = np.where(theirs < 0, top, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        k = int(apart.argmin())
        return langs[k], max(0.0, 1 - float(apart[k]) / (top * len(own)))

    names = [f.name for f in docs.schema]
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighter()
        for b in batches:
            found = [one(t) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return docs.mapInArrow(run, out)


def held_out() -> Column:
    """A row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def in_known_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs (text, lang, and any other columns) without the rows whose language is not told with score `least`.

    The profiles are those of all rows with a lang. Texts without letters are `und` and go.
    """
    found = predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), learn_profiles(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
