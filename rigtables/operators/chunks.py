"""Ordered work on long recordings in chunks, so that no recording has to fit one task.

A row's chunk is its order column divided by a size. Rows move once, by chunks, and windows run inside chunks; what crosses
a border is one summary row for each chunk, carried over by a window on those summaries and brought to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from rigtables.durable import kept

KEY = "recording_id"


#: Chunks whose summary rows are sent to all tasks; more meet the rows by a join.
MOST_CHUNKS = 200_000


def _chunked(df: DataFrame, order: str, size: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / size).cast("long"))


def _inside(order: str, ties: list[str] | None = None) -> WindowSpec:
    return W.partitionBy(KEY, "_chunk").orderBy(order, *(ties or []))


def _from_end() -> WindowSpec:
    """A chunk's rows from its last on: what lies ahead is found in one pass, where a window that reaches to the last row is read anew at every row."""
    return W.partitionBy(KEY, "_chunk").orderBy(F.desc("_row"))


def laid_out(df: DataFrame, order: str, size: int, columns: dict[str, Column], ties: list[str] | None = None, from_end: dict[str, Column] | None = None) -> DataFrame:
    """df with its chunk, its 1-based row there and `columns` over windows of the chunk, those `from_end` by descending `_row`: moved once by chunks, and kept.

    Whatever else is asked of the rows, also across chunks, goes by beside() and moves them no more.
    """
    return kept(_chunked(df, order, size).withColumns({"_row": F.row_number().over(_inside(order, ties))} | columns).withColumns(from_end or {}))


def beside(rows: DataFrame, edges: DataFrame, n: int | None = None) -> DataFrame:
    """rows of laid_out() with the columns of edges, a row for each chunk: sent to all tasks unless there are over MOST_CHUNKS.

    `n` is their number; without it they are kept and counted here.
    """
    if n is None:
        edges = kept(edges)
        n = edges.count()
    return rows.join(F.broadcast(edges) if n <= MOST_CHUNKS else edges, [KEY, "_chunk"])


def starts(rows: DataFrame) -> Column:
    """How many rows of the recording come before a chunk of `_n` rows, over one row for each chunk."""
    return F.coalesce(F.sum("_n").over(W.partitionBy(KEY).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, order: str, name: str, size: int, ties: list[str] | None = None) -> DataFrame:
    """df with its 0-based place within the recording in the order of `order`, then `ties`."""
    rows = laid_out(df, order, size, {"_n": F.count("*").over(W.partitionBy(KEY, "_chunk"))}, ties)
    chunks = rows.where("_row = 1").select(KEY, "_chunk", "_n")
    placed = beside(rows.drop("_n"), chunks.select(KEY, "_chunk", starts(chunks).alias("_start")))
    return placed.select(*df.columns, (F.col("_start") + F.col("_row") - 1).alias(name))


def carried(df: DataFrame, order: str, size: int, value: Column, back: str | None = "before", ahead: str | None = "after", strict: bool = False, ties: list[str] | None = None, keep: bool = True) -> DataFrame:
    """df with the last non-null value at or before each row, and the first at or after it (strict: not at it).

    Rows are moved once and kept; without `keep` (rows too wide to be written) they are moved once, and read again for their chunks' summaries.
    """
    if back is None and ahead is None:
        return df
    edge, inside = 1 if strict else 0, _inside(order, ties)
    named = df.withColumn("_value", value)
    own, own_after = {}, {}
    if back:
        own["_before"] = F.last("_value", True).over(inside.rowsBetween(W.unboundedPreceding, -edge))
    if ahead:
        own_after["_after"] = F.last("_value", True).over(_from_end().rowsBetween(W.unboundedPreceding, -edge))
    by_chunk = W.partitionBy(KEY)
    into, out = (F.last(c, True).over(by_chunk.orderBy(o).rowsBetween(W.unboundedPreceding, -1)).alias(n) for c, o, n in (("_last", F.asc("_chunk"), "_in"), ("_first", F.desc("_chunk"), "_out")))
    if keep:
        whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        rows = laid_out(named, order, size, own | {"_last": F.last("_value", True).over(whole), "_first": F.first("_value", True).over(whole)}, ties, own_after)
        found = beside(rows.drop("_last", "_first"), rows.where("_row = 1").select(KEY, "_chunk", into, out))
    else:
        parts, place = _chunked(named, order, size), F.struct(order, *(ties or []))
        some = parts.where("_value IS NOT NULL").groupBy(KEY, "_chunk").agg(F.max_by("_value", place).alias("_last"), F.min_by("_value", place).alias("_first"))
        chunks = parts.select(KEY, "_chunk").distinct().join(some, [KEY, "_chunk"], "left")
        rows = parts.withColumns(own | ({"_row": F.row_number().over(inside)} if ahead else {})).withColumns(own_after)
        found = rows.join(chunks.select(KEY, "_chunk", into, out), [KEY, "_chunk"])
    made = [F.coalesce(c, e).alias(n) for c, e, n in (("_before", "_in", back), ("_after", "_out", ahead)) if n]
    return found.select(*df.columns, *made)


def lagged(df: DataFrame, order: str, value: str, name: str, size: int, ties: list[str] | None = None, keep: bool = True) -> DataFrame:
    """df with the value of the row before, null for a recording's first row."""
    return carried(df, order, size, F.col(value), back=name, ahead=None, strict=True, ties=ties, keep=keep)


def last_at_or_before(ordered: Column, value: Column, most: int) -> Column:
    """The index of the last number of an ascending array of up to `most` that is not over `value`, by binary search; -1 if all are."""
    widths = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))))
    return F.aggregate(widths, F.lit(-1), lambda at, w: F.when(F.get(ordered, at + w) <= value, at + w).otherwise(at))
