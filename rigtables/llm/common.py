"""What several text operators share: safe intermediate tables, components, ordered offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.durable import fresh_path, kept, shared_dir

__all__ = ["kept", "shared_dir"]

#: Words are runs of characters outside this class (space, tab, LF, VT, FF, CR).
WORD = "[^\\x20\\x09-\\x0D]+"
#: The two texts with which ASCII letters are lower-cased by translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage at a compressed Parquet table in the shared folder; for wide rows."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of bounded bytes, so that long ones do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a text column, one row at least in each."""
    texts = batch.column(column)
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    first = np.append((np.diff((ends[1:] - ends[0]) // most, prepend=-1) > 0).nonzero()[0], len(texts))
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield batch.slice(i, j - i)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node reachable, for nodes that have an edge.

    `edges` has long columns a, b. Alternates large-star and small-star rounds; every round
    is two partial aggregations and two joins, with no group gathered in one place, and ends
    at a checkpoint. Self-loops and repeated edges do no harm; no edges give no rows.
    """
    now = edges.where("a != b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    now, before = kept(now), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").selectExpr("b AS a", "m AS b")
        now = kept(small.unionByName(least.withColumnRenamed("m", "b")).where("a != b").distinct())
    return now.selectExpr("a AS node", "b AS component").unionByName(now.selectExpr("b AS node", "b AS component").distinct())


#: Bytes of wide rows that one sorted partition should hold.
PART_BYTES = 128 << 20


def parts_for(spark: SparkSession, size: int) -> int:
    """Partitions for `size` bytes: those of the session, or more where they would hold over PART_BYTES each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def in_order(df: DataFrame, keys: list[str], size: str, name: str, width: int = 1) -> DataFrame:
    """df with long `part` and `start`: the sum of `size` over all rows before, in the order of `keys`.

    Range partitions (equal keys may be split by the later ones) each keep a running sum; only
    one total for each partition reaches the driver, and is broadcast back.
    The sorted rows are written first, so that both passes see the same partitions. `width` is the number
    of bytes of a row for each unit of its size; df is read for their sum.
    """
    spark, schema = df.sparkSession, df.schema
    count = parts_for(spark, width * (df.agg(F.sum(size)).first()[0] or 0))
    fields = df.columns
    at = fields.index(size)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sizes = batch.column(at + 1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - sizes)], names=["part", *fields, "start"])

    out = "part long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", start long"
    ranged = df.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    ordered = written(ranged.select(F.spark_partition_id().cast("long").alias("part"), *fields).mapInArrow(running, out), name)
    return ordered.join(F.broadcast(totals_before(ordered, size)), "part").select(*ordered.columns[:-1], (F.col("start") + F.col("before")).alias("start"))


def totals_before(parts: DataFrame, size: str) -> DataFrame:
    """(part, before): what all lower parts have of `size`; a row for each partition, so bounded by their number."""
    before, rows = 0, []
    for part, total in sorted(parts.groupBy("part").agg(F.sum(size)).collect()):
        rows.append((part, before))
        before += total
    return parts.sparkSession.createDataFrame(rows, "part long, before long")


#: At most so many keys, those with the most rows, are looked up in a broadcast.
HOT = 1 << 12


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows with the columns of `found`, one row for each key; rows without their key there are left out.

    `n` of found is how many of the rows have the key, or more. Keys that have over 1 in HOT of all, of which there are
    fewer than HOT, are known to every task; the others meet in a join, none of them with more rows than that. Keys must not be null.
    """
    most = (found.agg(F.sum(n)).first()[0] or 0) // HOT
    many = F.broadcast(found.where(F.col(n) > most))
    few = rows.join(many.select(*keys), keys, "left_anti").join(found.where(F.col(n) <= most), keys)
    met = rows.join(many, keys)
    return met.unionByName(few)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an expression of ASCII characters, bit by bit."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substr({text}, CAST(i AS INT), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    turn = "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce({steps}, {turn}, 4294967295::BIGINT), 4294967295)"
