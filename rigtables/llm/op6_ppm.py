"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ORDER bytes, counted over all training texts, with escape
estimation by method C and symbol exclusion. Since the counts are fixed before scoring, what a context
leaves to its shorter one after exclusion is a property of the context, and Spark works it out once by
joining each level of the trie with the next; likewise the probability of every gram (a byte with the bytes
before it) that any text has. A text's score is its log10 probability, its end included.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.llm.common import kept, small_batches, table, written

#: Bytes of context; a symbol has 9 bits: a byte, or 256 for the end (as a symbol) or the time before the start (in a context).
ORDER, SYMBOL, NONE = 4, 9, 256
SYMBOLS = 257
#: Bytes of text that are made into grams at a time; rows of text handled at a time; grams that a task holds.
STEP, ROWS, HELD = 1 << 19, 1 << 15, 500_000
#: Tokens, and grams, that make up at least 1 in SHARE of all are known to each task; so there are at most SHARE of them.
SHARE = 1 << 18
GRAM_SHARE = 1 << 20
END = b"\n"


def windows(texts: list[str | None], order: int = ORDER, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of its text, code) of each byte of each text and its end: `order` symbols before it and itself.

    Long texts are cut into pieces, short ones put together, so that about `step` symbols are held at a time.
    """
    held: list[np.ndarray] = []
    owners: list[tuple[int, int]] = []
    end, room = np.array([NONE], np.uint16), 0

    def codes() -> tuple[np.ndarray, np.ndarray]:
        stream = np.concatenate(held).astype(np.int64)
        code = np.zeros(len(stream) - order, np.int64)
        for k in range(order + 1):
            code = code << SYMBOL | stream[k : len(stream) - order + k]
        sizes = np.array([n for _, n in owners])
        take = np.ones(len(code), bool)
        starts = np.cumsum(sizes + order)[:-1]  # codes that would end in the next piece's context
        for k in range(order):
            take[starts - order + k] = False
        return np.repeat([t for t, _ in owners], sizes), code[take]

    for t, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        for i in range(0, len(raw) + 1, step):
            piece = raw[max(0, i - order) : i + step]
            last = i + step > len(raw)
            held += [np.full(max(0, order - i), NONE, np.uint16), piece, *([end] if last else [])]
            owners.append((t, min(step, len(raw) + 1 - i)))
            room += owners[-1][1]
            if room >= step:
                yield codes()
                held, owners, room = [], [], 0
    if owners:
        yield codes()


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n, every) for docs (text, learn): how often each gram is in the texts to learn from, and in all."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            codes, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return codes, *(np.bincount(at, np.concatenate([h[k] for h in held])).astype(np.int64) for k in (1, 2))

        for b in batches:
            texts, learn = b.column(0).to_pylist(), b.column(1).to_pylist()
            for own in (True, False):
                for _, codes in windows([t for t, x in zip(texts, learn, strict=True) if x == own], order):
                    counted = pc.value_counts(pa.array(codes))
                    n = np.asarray(counted.field(1))
                    held.append((np.asarray(counted.field(0)), n * own, n))
                    if sum(len(h[0]) for h in held) > 2 * HELD:
                        held = [merged()]
                        if len(held[0][0]) > HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["gram", "n", "every"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["gram", "n", "every"])

    counted = docs.select("text", "learn").mapInArrow(run, "gram long, n long, every long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def _log(c: Column) -> Column:
    return F.when(c > 0, F.log10(c.cast("double"))).otherwise(0.0)


def trie(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Levels of the trie as rows (level, context, symbol, ...), from counts (gram, n).

    Symbol rows hold hit: log10(n), and all: log10 of the context's total with escapes. Node rows (symbol
    null) hold escape: log10 of the chance to leave the context when it comes first; and, for those who
    come from it to the next shorter context with its symbols excluded, below: log10 of what is left there
    with escapes, and leave: log10 of the chance to leave that context too.
    """
    levels, nodes = [None] * (order + 1), [None] * (order + 1)
    rows = counts.select("gram", "n")
    for level in range(order, -1, -1):  # each level's counts are sums of the next longer one's
        rows = kept(rows.groupBy(F.expr(f"gram & {(1 << SYMBOL * (level + 1)) - 1}L").alias("gram")).agg(F.sum("n").alias("n")))
        own = rows.select(F.expr(f"shiftright(gram, {SYMBOL})").alias("context"), (F.col("gram") % (1 << SYMBOL)).alias("symbol"), "n")
        for k in range(level):  # contexts that reach before the start are shorter ones
            own = own.where(F.expr(f"shiftright(context, {SYMBOL * k}) & {(1 << SYMBOL) - 1}L") != NONE)
        levels[level] = own
        nodes[level] = own.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    out = None
    for level in range(order + 1):
        node = nodes[level].select("context", "total", "kinds")
        if level:
            shorter = F.expr(f"context & {(1 << SYMBOL * (level - 1)) - 1}L")
            parent = levels[level - 1].select(F.col("context").alias("shorter"), "symbol", F.col("n").alias("n_below"))
            gone = levels[level].withColumn("shorter", shorter).join(parent, ["shorter", "symbol"]).groupBy("context").agg(F.sum("n_below").alias("gone"))
            above = nodes[level - 1].select(F.col("context").alias("shorter"), F.col("total").alias("total_below"), F.col("kinds").alias("kinds_below"))
            node = node.join(gone, "context").withColumn("shorter", shorter).join(above, "shorter")
            left, kinds = F.col("total_below") - F.col("gone"), F.col("kinds_below") - F.col("kinds")
        else:
            left, kinds = SYMBOLS - F.col("kinds"), F.lit(0)
        some = node.select(
            F.lit(level).alias("level"), "context", F.lit(None).cast("long").alias("symbol"), F.lit(None).cast("double").alias("hit"),
            _log(F.col("total") + F.col("kinds")).alias("all"), (_log(F.col("kinds")) - _log(F.col("total") + F.col("kinds"))).alias("escape"),
            _log(left + kinds).alias("below"), (_log(kinds) - _log(left + kinds)).alias("leave"),
        )
        hits = levels[level].select(F.lit(level).alias("level"), "context", "symbol", F.log10(F.col("n").cast("double")).alias("hit"), *(F.lit(None).cast("double").alias(c) for c in ("all", "escape", "below", "leave")))
        out = some.unionByName(hits) if out is None else out.unionByName(some).unionByName(hits)
    return kept(out)


def gram_scores(trie_rows: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, log10p) of the distinct grams `wanted`, by joins with the trie, level by level."""
    state = wanted.select("gram", F.lit(0.0).alias("p"), F.lit(False).alias("done"), F.lit(None).cast("double").alias("below"), F.lit(None).cast("double").alias("leave"))
    for k in range(order, -1, -1):
        own = trie_rows.where(F.col("level") == k)
        hits = own.where("symbol IS NOT NULL").select(F.expr(f"shiftleft(context, {SYMBOL}) | symbol").alias("key"), "hit")
        nodes = own.where("symbol IS NULL").select(F.col("context").alias("at"), "all", "escape", F.col("below").alias("next_below"), F.col("leave").alias("next_leave"))
        key = F.expr(f"gram & {(1 << SYMBOL * (k + 1)) - 1}L")
        state = state.withColumn("key", key).withColumn("at", F.expr(f"shiftright(gram, {SYMBOL}) & {(1 << SYMBOL * k) - 1}L"))
        state = state.join(hits, "key", "left").join(nodes, "at", "left")
        hit = F.col("hit") - F.coalesce("below", "all")
        missed = F.when(F.col("all").isNull(), 0.0).otherwise(F.coalesce("leave", "escape"))
        state = state.select(
            "gram", F.when(F.col("done"), F.col("p")).otherwise(F.col("p") + F.coalesce(hit, missed)).alias("p"),
            (F.col("done") | F.col("hit").isNotNull()).alias("done"), F.col("next_below").alias("below"), F.col("next_leave").alias("leave"),
        )
    return state.select("gram", F.when(F.col("done"), F.col("p")).otherwise(F.col("p") - F.coalesce("below", F.lit(math.log10(SYMBOLS)))).alias("log10p"))


def parts_of(own: dict[str, list | np.ndarray], rare: tuple[list | np.ndarray, pa.Array, pa.Array], key: pa.DataType) -> pa.RecordBatch:
    """What rows have by themselves, each under a key of its own, and rare keys with the rows that they are in, how often."""
    keys, rows, times = rare
    n = len(own["row"])
    one = np.arange(n + 1, dtype=np.int32)
    single = pa.ListArray.from_arrays(one, pa.array(own["row"], pa.int64()))
    none = pa.ListArray.from_arrays(one, pa.array(np.zeros(n, np.int64)))
    columns = {"key": pa.concat_arrays([pa.array(own["key"], key), pa.array(keys, key)]), "rows": pa.concat_arrays([single, rows]), "times": pa.concat_arrays([none, times])}
    for name, values in own.items():
        if name not in ("row", "key"):
            filled = pa.array(values)
            columns[name] = pa.concat_arrays([filled, pa.array(np.zeros(len(keys)), filled.type)])
    return pa.RecordBatch.from_pydict(columns)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, pa.int64()))


def ppm_parts(rows: DataFrame, counts: DataFrame, order: int = ORDER, share: int = GRAM_SHARE) -> DataFrame:
    """(row, p): what adds up to the score of each of rows (row, text); counts are count_grams() of these texts and the model's.

    Every gram is scored once. The scores of grams that make up at least 1 in `share` of all are known to
    every task; any other goes, once for a batch of rows with the rows it is in, to meet its score in a join.
    """
    small_batches(rows.sparkSession)
    levels = trie(counts.where("n > 0"), order)
    scored = kept(gram_scores(levels, counts.select("gram"), order).join(counts.select("gram", "every"), "gram"))
    total = scored.agg(F.sum("every")).first()[0] or 0
    some = scored.where(F.col("every") * share >= total).select("gram", "log10p").toArrow()
    by = np.argsort(some.column(0).to_numpy())
    known = rows.sparkSession.sparkContext.broadcast(tuple(some.column(c).to_numpy()[by] for c in (0, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, logs = known.value
        for whole in batches:
            for i in range(0, len(whole), ROWS):
                b = whole.slice(i, ROWS)
                names, own, met, n = b.column(0).to_numpy(), np.zeros(len(b)), [], 0
                for owner, codes in windows(b.column(1).to_pylist(), order):
                    each = pa.array(codes).dictionary_encode()
                    asked, at = each.dictionary.to_numpy(), each.indices.to_numpy()
                    k = np.minimum(np.searchsorted(grams, asked), max(0, len(grams) - 1))
                    hit = grams[k] == asked if len(grams) else np.zeros(len(asked), bool)
                    own += np.bincount(owner, np.where(hit, logs[k], 0.0)[at] if len(grams) else None, minlength=len(b)) * (len(grams) > 0)
                    lost = ~hit[at]
                    met.append(codes[lost] << 16 | owner[lost])
                    n += len(met[-1])
                    if n > 2 * HELD:
                        yield parts_of({"key": [], "row": [], "p": np.zeros(0)}, rare(names, met), pa.int64())
                        met, n = [], 0
                yield parts_of({"key": -1 - names, "row": names, "p": own}, rare(names, met), pa.int64())

    def rare(names: np.ndarray, met: list[np.ndarray]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        pair, times = np.unique(np.concatenate(met) if met else np.zeros(0, np.int64), return_counts=True)
        gram = pair >> 16
        last = np.append(gram[1:] != gram[:-1], True)[: len(gram)]
        ends = last.nonzero()[0] + 1
        return gram[last], _lists(ends, names[pair & 0xFFFF]), _lists(ends, times)

    parts = rows.select("row", "text").mapInArrow(run, "key long, rows array<long>, times array<long>, p double")
    met = parts.join(scored.select(F.col("gram").alias("key"), "log10p"), "key", "left").select("p", "log10p", F.explode(F.arrays_zip("rows", "times")).alias("x"))
    return met.select(F.col("x.rows").alias("row"), (F.col("p") + F.col("x.times") * F.coalesce("log10p", F.lit(0.0))).alias("p"))


def ppm_scores(rows: DataFrame, training: DataFrame, order: int = ORDER, share: int = GRAM_SHARE) -> DataFrame:
    """(row, score): log10 probability of each text of rows (row, text) under a model of training's texts.

    Without training texts all symbols are alike.
    """
    texts = rows.select("text", F.lit(False).alias("learn")).unionByName(training.select("text", F.lit(True).alias("learn")))
    return ppm_parts(rows, kept(count_grams(texts, order)), order, share).groupBy("row").agg(F.sum("p").alias("score"))


def unigram_parts(rows: DataFrame, share: int = SHARE) -> tuple[DataFrame, int, float]:
    """(parts, training tokens, log10 of the base model's denominator) for rows (row, text, learn).

    parts (row, n_tokens, n_known, base) add up, by row, to its tokens, those of them that are known, and the log10 of
    their smoothed counts. Tokens are lower-cased words and one end for each text. Tokens that make up at least
    1 in `share` of the training tokens are known to every task; each task sends any other token once, with the
    rows it is in, to meet its count in a join.
    """
    spark = rows.sparkSession
    small_batches(spark)

    def words(text: str | None) -> list[bytes]:
        return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                total.update(words(t))
                if len(total) > HELD:
                    yield pa.RecordBatch.from_pydict({"token": pa.array(total, pa.binary()), "c": pa.array(total.values(), pa.int64())})
                    total.clear()
        yield pa.RecordBatch.from_pydict({"token": pa.array(total, pa.binary()), "c": pa.array(total.values(), pa.int64())})

    counts = kept(rows.where("learn").select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    below = math.log10(n + 0.1 * (v + 1)) if n else math.log10(0.1)
    frequent = spark.sparkContext.broadcast({bytes(r[0]): math.log10(r[1] + 0.1) for r in counts.where(F.col("c") * share >= n).collect()})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for b in batches:
            own, rare = [], {}
            names = b.column(0).to_pylist()
            for row, text in zip(names, b.column(1).to_pylist(), strict=True):
                w = Counter(words(text))
                seen = w.keys() & known.keys()
                for token in w.keys() - seen:
                    rare.setdefault(token, []).append((row, w[token]))
                own.append((w.total(), sum(w[t] for t in seen), sum(w[t] * known[t] for t in seen)))
            ends = np.cumsum([len(x) for x in rare.values()])
            met = np.array([p for x in rare.values() for p in x], np.int64).reshape(-1, 2)
            tokens, seen, base = (list(x) for x in zip(*own, strict=True)) if own else ([], [], [])
            of_row = {"key": [b"\n%d" % r for r in names], "row": names, "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(seen, pa.int64()), "base": pa.array(base, pa.float64())}
            yield parts_of(of_row, (list(rare), _lists(ends, met[:, 0]), _lists(ends, met[:, 1])), pa.binary())

    parts = rows.select("row", "text").mapInArrow(split, "key binary, rows array<long>, times array<long>, n_tokens long, n_known long, base double")
    met = parts.join(counts.withColumnRenamed("token", "key"), "key", "left").select("*", F.explode(F.arrays_zip("rows", "times")).alias("x"))
    k = F.col("x.times")
    out = met.select(
        F.col("x.rows").alias("row"),
        "n_tokens",
        (F.col("n_known") + F.when(F.col("c").isNotNull(), k).otherwise(0)).alias("n_known"),
        (F.col("base") + k * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("base"),
    )
    return out, n, below


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    The models learn from the rows that are not held out. Null texts are empty: their end alone is scored.
    Repeated rows are counted and scored as often as they come. No rows give no rows; if all are held out,
    nothing is known and all bytes are alike. Other columns are ignored. docs is read once; its rows are written
    with their ids.
    """
    learn = ~F.coalesce(held_out, F.lit(False))
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", learn.alias("learn")), "numbered")
    base, n, below = unigram_parts(rows)
    score = ppm_parts(rows, kept(count_grams(rows)))
    every = base.unionByName(score, allowMissingColumns=True).unionByName(rows.select("row", "doc_id", "learn"), allowMissingColumns=True)
    sums = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("learn").alias("learn"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "p")))
    base_score = F.col("base") - F.col("n_tokens") * F.lit(below)
    return sums.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base_score.alias("base_score"), F.col("p").alias("score"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return lm_scores(table(spark, sf_dir, "documents"), held_out)
