"""Exact quantiles of groups of any size: by Spark's own percentile where groups are small, else by histograms refined for all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rigtables.durable import kept

#: Rows of the largest group of which a task may hold the values; bins of a group in one pass; values of a group that are sorted at last.
SMALL, BINS, LAST = 100_000, 4096, 10_000
#: Keys with over one in HOT of all rows, fewer than HOT of them, meet their rows by broadcast.
HOT = 4096


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows with the columns of found, one row for each key (not null), of which `n` says how many rows have it, or more; others are left out."""
    most = (found.agg(F.sum(n)).first()[0] or 0) // HOT
    many = F.broadcast(found.where(F.col(n) > most))
    few = rows.join(many.select(*keys), keys, "left_anti").join(found.where(F.col(n) <= most), keys)
    return rows.join(many, keys).unionByName(few)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).agg(F.max("_rows")).first()[0] or 0


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], small: int = SMALL, largest: int | None = None, bins: int = BINS, last: int = LAST) -> DataFrame:
    """(keys, a column for each of `wanted`: name -> (values, q)): the q-quantile of a group's values, on the line between the two ranks around.

    Nulls don't count; a group without values has null; NaN is above all numbers. Keys may be null. Groups are counted first, unless the rows of the `largest`
    are known: if none has over `small` rows, percentile() takes them. Otherwise every pass counts the values of each group in `bins` equal ranges and goes on
    with the range that holds the rank, until it has few distinct values or is one value; only those are sorted. No group is held
    or sorted as a whole, and a hot group stays spread over its tasks.
    """
    names = list(wanted)
    rows = df.select(*keys, *(c.cast("double").alias(n) for n, (c, _) in wanted.items()))
    if (largest_group(rows, keys) if largest is None else largest) <= small:
        return rows.groupBy(*keys).agg(*(F.percentile(n, F.lit(q)).alias(n) for n, (_, q) in wanted.items()))
    rows = kept(rows)
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    each = rows.select(group.alias("_g"), F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(n).alias("v")) for n in names))).alias("_e"))
    each = kept(each.select(F.concat_ws("/", "_e.n", "_g").alias("_g"), F.col("_e.n").alias("_name"), F.col("_e.v").alias("_v")).where("_v IS NOT NULL"))
    finite = F.when(~F.isnan("_v") & (F.abs("_v") != float("inf")), F.col("_v"))
    q = F.element_at(F.create_map(*(x for n, (_, p) in wanted.items() for x in (F.lit(n), F.lit(float(p))))), F.col("_name"))
    stats = each.groupBy("_g", "_name").agg(F.count("*").alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")).withColumn("_r", q * (F.col("_n") - 1))
    ranks = F.array_distinct(F.array(F.floor("_r").cast("long"), F.ceil("_r").cast("long")))
    whole = kept(stats)
    state = kept(whole.select("_g", F.explode(ranks).alias("_rank"), "_n", "_lo", "_hi", F.col("_rank").alias("_left")))
    place = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins), F.lit(bins - 1)).cast("long")
    odd = F.when(F.isnan("_v"), bins + 1).when(F.col("_v") == float("inf"), bins).when(F.col("_v") == float("-inf"), -1)
    at = F.coalesce(odd, F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(place)).cast("long")
    first = True
    while True:
        targets = state.groupBy("_g").agg(F.collect_list(F.struct("_rank", "_lo", "_hi")).alias("_t"), F.max("_n").alias("_n"))  # one or two ranks
        met = looked_up(each.select("_g", "_v"), targets, ["_g"], "_n").select("_g", "_v", F.explode("_t").alias("t")).select("_g", "_v", "t.*")
        inside = met if first else met.where("_v >= _lo AND _v <= _hi")
        counted = inside.groupBy("_g", "_rank", at.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_bl"), F.max("_v").alias("_bh"))
        before = F.coalesce(F.sum("_c").over(W.partitionBy("_g", "_rank").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hit = counted.withColumn("_before", before).join(state.select("_g", "_rank", "_n", "_left"), ["_g", "_rank"]).where("_before <= _left AND _left < _before + _c")
        state = kept(hit.select("_g", "_rank", "_n", F.col("_bl").alias("_lo"), F.col("_bh").alias("_hi"), (F.col("_left") - F.col("_before")).alias("_left"), "_c"))
        first = False
        if not state.where((F.col("_c") > last) & ~F.col("_lo").eqNullSafe(F.col("_hi"))).take(1):
            break
    state = state.select("_g", "_rank", "_n", "_lo", "_hi", "_left")
    targets = state.groupBy("_g").agg(F.collect_list(F.struct("_rank", "_lo", "_hi", "_left")).alias("_t"), F.max("_n").alias("_n"))
    met = looked_up(each.select("_g", "_v"), targets, ["_g"], "_n").select("_g", "_v", F.explode("_t").alias("t")).select("_g", "_v", "t.*")
    values = met.where("_v >= _lo AND _v <= _hi").groupBy("_g", "_rank", "_left", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("_g", "_rank").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    found = values.withColumn("_upto", upto).where("_left < _upto AND _left >= _upto - _c").select("_g", "_rank", "_v")
    ends = found.groupBy("_g").agg(F.min_by("_v", "_rank").alias("_low"), F.max_by("_v", "_rank").alias("_high"))
    share = F.col("_r") - F.floor("_r")
    made = whole.join(ends, "_g").select("_g", F.when(share == 0, F.col("_low")).otherwise(F.col("_low") * (1 - share) + F.col("_high") * share).alias("_q"))
    out = rows.select(*keys).distinct().withColumn("_k", group)
    for n in names:
        one = made.select(F.col("_g").alias(f"_g_{n}"), F.col("_q").alias(n))
        out = out.join(one, F.concat_ws("/", F.lit(n), "_k") == F.col(f"_g_{n}"), "left").drop(f"_g_{n}")
    return out.drop("_k")
