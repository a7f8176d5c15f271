"""Quality by weak supervision, with DataFrame functions only.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote
patterns (at most 3 to the number of rules, whatever the corpus) estimates how each rule votes on good and on bad
documents, and the posterior probability of good quality decides, instead of a demand that all rules pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.llm.common import kept, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often later expressions use them."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def text_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the rules need besides.

    3-word windows are told apart by 64-bit hashes of their words, within one text; they are sorted only in texts
    that repeat one.
    """
    text = F.coalesce("text", F.lit(""))
    df = _held(docs.select("doc_id", text.alias("text")), words=F.filter(F.split("text", SPACE), lambda w: w != ""))
    n = F.size("words")
    whole = F.transform(F.slice("words", F.lit(3), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(F.get("words", i), F.get("words", i + 1), w))
    df = _held(df, windows=whole)
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = _held(df, by_window=F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    later = F.slice("by_window", F.lit(2), F.greatest(F.size("by_window"), F.lit(1)))
    same = F.zip_with("by_window", later, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    df = _held(df, same=same)
    before = F.concat(F.array(F.lit(False)), "same")
    marked = F.zip_with(F.zip_with("same", before, lambda a, b: a | b), "by_window", lambda s, w: F.when(s, w["i"]))
    starts = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    df = _held(df, lines=F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != ""))
    long = lambda c: c.cast("long")
    return df.select(
        "doc_id",
        long(F.size("words")).alias("n_words"),
        long(F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.when(F.size("lines") > 1, F.size("lines") - F.size(F.array_distinct("lines"))).otherwise(0)).alias("n_dup_lines"),
        long(covered).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(r"[.!?…\"'”»)]\s*$"))))).alias("n_closed_lines"),
        long(F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))).alias("n_letters"),
    )


def votes() -> dict[str, Column]:
    """1 votes good, -1 bad, 0 abstains."""
    c = F.col
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    mean = c("word_chars") / F.greatest(c("n_words"), F.lit(1))
    return {
        "v_length": vote(c("n_words") >= 100, c("n_words") < 50),
        "v_word_length": vote(mean.between(3.5, 9), (mean < 2.5) | (mean > 12) | (c("n_words") == 0)),
        "v_symbols": vote(c("n_symbols") <= 0.02 * c("n_words"), c("n_symbols") > 0.1 * c("n_words")),
        "v_dup_lines": vote((c("n_dup_lines") == 0) & (c("n_lines") >= 3), c("n_dup_lines") > 0.3 * c("n_lines")),
        "v_repeats": vote(c("n_repeat_words") <= 0.1 * c("n_words"), c("n_repeat_words") > 0.3 * c("n_words")),
        "v_closed": vote(c("n_closed_lines") >= 0.7 * c("n_lines"), (c("n_closed_lines") < 0.3 * c("n_lines")) | (c("n_lines") == 0)),
        "v_letters": vote(c("n_letters") >= 0.85 * c("word_chars"), (c("n_letters") < 0.7 * c("word_chars")) | (c("word_chars") == 0)),
    }


#: At the start, how a rule votes bad, abstains and votes good on bad and on good documents.
BELIEF = {0: (0.4, 0.2, 0.4), 1: (0.02, 0.08, 0.9)}


def fit_votes(patterns: Sequence[tuple[Sequence[int], int]], rounds: int = 200, prior: float = 0.02) -> tuple[float, list[dict[int, list[float]]]]:
    """(share of good documents, for each rule its votes' probabilities by class) by expectation-maximisation.

    The starting belief weighs as much as `prior` of the documents. A rule's probability to vote bad
    (good) is never lower (higher) on bad documents than on good ones, so the classes cannot swap.
    No patterns leave the start as it is.
    """
    rules = len(patterns[0][0]) if patterns else 0
    good, rates = 0.9, [{c: list(p) for c, p in BELIEF.items()} for _ in range(rules)]
    weight = prior * sum(n for _, n in patterns) + 1
    for _ in range(rounds):
        seen = [{c: [weight * q for q in p] for c, p in BELIEF.items()} for _ in range(rules)]
        share = {0: 0.1 * weight, 1: 0.9 * weight}
        for pattern, n in patterns:
            p = posterior(pattern, good, rates)
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                share[c] += w
                for j, v in enumerate(pattern):
                    seen[j][c][v + 1] += w
        good = share[1] / (share[0] + share[1])
        rates = [{c: [q / sum(x[c]) for q in x[c]] for c in x} for x in seen]
        for x in rates:
            x[1][0], x[0][2] = min(x[1][0], x[0][0]), min(x[0][2], x[1][2])
    return good, rates


def weights(good: float, rates: Sequence[dict[int, list[float]]]) -> tuple[float, list[list[float]]]:
    """Log odds of good: of any document, and what each vote (bad, abstain, good) of each rule adds."""
    return math.log(good / (1 - good)), [[math.log(g / b) for b, g in zip(x[0], x[1], strict=True)] for x in rates]


def posterior(pattern: Sequence[int], good: float, rates: Sequence[dict[int, list[float]]]) -> float:
    z, adds = weights(good, rates)
    return 1 / (1 + math.exp(-z - sum(a[v + 1] for v, a in zip(pattern, adds, strict=True))))


def weak_quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """text_counts() with the votes, base_failed, quality (posterior) and kept, for every row of docs (doc_id, text).

    kept is false if base_failed (under 50 words, or over half of them in repeated windows), else
    quality >= least. A null, empty or blank text has no words and fails. Repeated rows count as often as
    they come. No rows give no rows; other columns are ignored.
    """
    rules = votes()
    df = kept(text_counts(docs).withColumns(rules))
    found = df.groupBy(*rules).count().collect()  # at most 3 to the number of rules
    start, adds = weights(*fit_votes(sorted((tuple(r[:-1]), r[-1]) for r in found)))
    z = F.lit(start)
    for name, (bad, none, good) in zip(rules, adds, strict=False):
        z = z + F.when(F.col(name) < 0, bad).when(F.col(name) > 0, good).otherwise(none)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumns({"base_failed": failed, "quality": 1 / (1 + F.exp(-z))})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weak_quality(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
