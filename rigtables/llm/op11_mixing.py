"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight, up to `most` times what it has; what is over goes to the
sources below their caps, by weight, until none is above. A source whose target is r times its size gives every
document floor(r) times; the fraction that is left is filled with its documents in a seeded order, the last of
them in part, so that the words taken are the target's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rigtables.llm.common import WORD, in_order, kept, looked_up, table

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 11
#: Bits of a document's place in the order, how many are told apart at a time, and rows of a source that are ordered at once.
PLACE_BITS, STEP, GROUP = 60, 12, 1 << 16


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, size: Column, seed: int) -> Column:
    """A document's place in the seeded order of its source: a long of PLACE_BITS bits."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, PLACE_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size, place and the source as (none, src), which are never null."""
    source = F.col("source").cast("string")
    size = words_in(F.col("text"))
    return docs.select(
        *(c for c in docs.columns if c not in ("size", "none", "src", "place")),
        size.alias("size"),
        source.isNull().alias("none"),
        F.coalesce(source, F.lit("")).alias("src"),
        place(F.col("doc_id"), size, seed).alias("place"),
    )


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources (source_size, weight, ...) with `target`: weight times the level at which all targets make up share * all sizes.

    Each round caps what lies above its cap and raises the level for the rest; one row of totals reaches the driver.
    """
    if share > most:
        raise ValueError("no mix can take more of all sources than of each")
    cap = F.col("source_size") * F.lit(float(most))
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap
        row = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.count_if(full),
        ).first()
        if row[3] == capped or not row[2]:
            return sources.withColumn("target", F.when(full, cap).otherwise(F.col("weight") * F.lit(level)))
        capped, level = row[3], (share * row[0] - most * row[1]) / row[2]


def targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(none, src, source_size, rows, target, whole, extra) of sized() documents: sources by code point, null last, weigh `weights`, repeating."""
    sources = docs.groupBy("none", "src").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.lit(1).cast("long").alias("one"))
    ranked = in_order(kept(sources), ["none", "src"], "one", "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("start") % len(weights) + 1).cast("int"))
    filled = water_fill(kept(ranked.select("none", "src", "source_size", "rows", weight.alias("weight"))), share, most)
    words = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    return kept(filled.select("none", "src", "source_size", "rows", "target", whole.alias("whole"), (words - whole * F.col("source_size")).alias("extra")))


def edges(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with `edge`, the place at which a source's fraction ends, and `room`, the words it has left there.

    The place is found STEP bits at a time, from totals of so many groups of a source, until a group has about GROUP
    rows, so no source is sorted as a whole. Documents of equal places (repeated rows) are told apart later.
    """
    key, rows = ["none", "src"], sources.agg(F.max("rows")).first()[0] or 0
    steps = -(-max(0, rows.bit_length() - GROUP.bit_length()) // STEP)
    found = sources.select("*", F.lit(0).cast("long").alias("edge"), F.col("extra").alias("room"))
    upto = PLACE_BITS
    for bits in [*range(PLACE_BITS - STEP, PLACE_BITS - STEP * (steps + 1), -STEP)][:4] + [0]:
        inside = docs.select(*key, "size", "place")
        if upto < PLACE_BITS:
            inside = looked_up(inside, found.select(*key, "rows", "edge"), key, "rows").where(F.shiftright("place", upto) == F.shiftright("edge", upto))
        groups = inside.groupBy(*key, F.shiftright("place", bits).alias("at")).agg(F.sum("size").alias("size"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        begun = groups.withColumn("before", before).join(found, key).where("before <= room")
        last = begun.groupBy(*key).agg(F.max_by(F.struct("at", "before"), "at").alias("g"))
        found = kept(found.join(last, key).select(*sources.columns, F.shiftleft("g.at", bits).alias("edge"), (F.col("room") - F.col("g.before")).alias("room")))
        upto = bits
    return found


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """All rows of docs (doc_id, source, text, ...) with size, source_size, target and taken, the words the mix takes of them.

    A null or text without words has size 0 and nothing is taken of it; null sources are one source, the last. A row is placed
    by doc_id and size, so that reruns agree; like rows are taken one after another. `taken div size` is how often
    a row is taken whole, and the rest how many of its first words are taken once more. No rows give none; other
    columns stay, but `size`, `none`, `src` and `place` are replaced. docs is read several times.
    """
    key = ["none", "src"]
    every = sized(docs, seed)
    narrow = kept(every.select(*key, "doc_id", "size", "place"))
    found = edges(narrow, targets(narrow, weights, share, most))
    here = looked_up(every, found, key, "rows")
    once = F.when(F.col("place") < F.col("edge"), F.col("size")).otherwise(0)
    rest = here.where("place != edge").withColumn("once", once)
    ties = kept(here.where("place = edge").withColumn("_row", F.monotonically_increasing_id()))
    ranked = kept(in_order(ties, [*key, "doc_id", "size", "_row"], "size", "ties"))
    first = ranked.groupBy(*key).agg(F.min("start").alias("first"), F.count("*").alias("met"))
    tied = looked_up(ranked, first, key, "met").withColumn("once", F.least(F.greatest(F.expr("room - (start - first)"), F.lit(0)), F.col("size")))
    both = rest.unionByName(tied.select(*rest.columns))
    names = [c for c in docs.columns if c not in ("size", "none", "src", "place", "source_size", "target", "taken")]
    return both.select(*names, "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("once")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of docs for each time it is taken, with `copy` from 0; a document that is taken in part has its first words, space-joined."""
    plan = mix_plan(docs, **options).where("taken > 0")
    times = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr("CAST(ceil(taken / size) AS INT) - 1"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), words.cast("int")), " ")
    return times.withColumn("text", F.when(words < F.col("size"), cut).otherwise(F.col("text"))).select(*docs.columns, "copy")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k, sum(source_size) OVER () AS total FROM s),
l AS (  -- the level if the k - 1 sources that fill up first are capped
  SELECT *, (1.5::DOUBLE * total - 2 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT coalesce(min(k), 1000000000) AS k FROM l WHERE weight * level <= 2 * source_size),
g AS (SELECT level FROM l JOIN f USING (k)),
t AS (
  SELECT source, source_size, CASE WHEN o.k < f.k THEN CAST(2 * source_size AS DOUBLE) ELSE weight * (SELECT level FROM g) END AS target FROM o, f),
p AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY
      ('0x' || substr(md5('11:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.size), 1, 15))::BIGINT, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + least(greatest(CAST(floor(target) AS BIGINT) - whole * source_size - before, 0), size) AS BIGINT) AS taken
FROM p
"""
