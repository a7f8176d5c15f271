"""A trie of conversation prefixes, screened by a count-min sketch.

Every prefix of a conversation has a digest of 128 bits. A count-min sketch of all digests, of bounded size,
proves most of them to be one conversation's alone: an estimate of one can't be too low. Such tails become nodes
where they are. Only digests that may be shared move, to be grouped exactly.

What a node sums up over its subtree comes without going through the trie level by level: each node belongs to the
smallest of its conversations, so every conversation adds up the nodes that are its own from its end backwards, and a
node's sum is the sum of what its conversations have from there on.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rigtables.llm.common import WORD, crc32_sql, in_order, kept, looked_up, table, written

#: Rows of the sketch, most and least counters in a row, counters that are merged at a time.
ROWS, MOST, LEAST, BLOCK = 3, 1 << 25, 1 << 16, 1 << 16
#: Turns of a conversation that are added up at a time; ids that are joined at a time.
STRETCH, IDS = 1 << 16, 1 << 12
DIGEST, NOTHING = ["da", "db"], sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, role, text, start) in order, and (conv_id, first, n): a turn's number in its conversation is start - first."""
    one = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("row")
    )
    ordered = in_order(one, ["conv_id", "turn", "role", "text", "row"], "one", "turns").select("conv_id", "role", "text", "start")
    return ordered, kept(ordered.groupBy("conv_id").agg(F.min("start").alias("first"), F.count("*").alias("n")))


def grafted(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Rebuilt turns (conv_id, depth, length, role, text), and a row of depth 0 for each conversation.

    Conversation c begins with the first h = crc32(c) % heads turns of conversation c - c % family and goes on
    with its own turns after its first h. `length` is the number of its rebuilt turns.
    """
    ordered, spans = numbered(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    plan = spans.select("conv_id", "first", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = spans.where(F.col("conv_id") % family == 0)
    plan = plan.join(bases.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    borrowed = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = kept(plan.select("conv_id", "first", "n", "h", "base", borrowed.alias("borrowed"), (borrowed + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    placed = looked_up(ordered, plan, ["conv_id"], "n").withColumn("at", F.col("start") - F.col("first"))
    own = placed.where("at >= h").select("conv_id", F.expr("at - h + borrowed + 1").alias("depth"), "length", "role", "text")
    head = placed.where((F.col("conv_id") % family == 0) & (F.col("at") < heads - 1)).select(F.col("conv_id").alias("base"), "at", "role", "text")
    taken = plan.where("borrowed > 0").join(kept(head), "base").where("at < borrowed")
    root = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return own.unionByName(taken.select("conv_id", (F.col("at") + 1).alias("depth"), "length", "role", "text")).unionByName(root)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, length, words, xa, xb, da, db) for rebuilt turns: da and db name the prefix, da ^ xa and db ^ xb its parent's.

    A prefix is named by the exclusive or of hashes of its turns with their depths, so that a long conversation
    is added up by stretches of STRETCH turns, and the stretches' sums then.
    """
    named = turns.select(
        "conv_id",
        "depth",
        "length",
        F.when(F.col("depth") > 0, F.regexp_count("text", F.lit(WORD))).otherwise(0).alias("words"),
        *(F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "role", "text")).otherwise(0).alias(x) for x, seed in (("xa", 1), ("xb", 2))),
        F.expr(f"depth div {STRETCH}").alias("stretch"),
    )
    inside = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    sums = named.select("*", *(F.bit_xor(x).over(inside).alias(d) for x, d in zip(("xa", "xb"), DIGEST, strict=True)))
    before = named.where(F.col("length") >= STRETCH).groupBy("conv_id", "stretch").agg(F.bit_xor("xa").alias("ya"), F.bit_xor("xb").alias("yb"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("conv_id", "stretch", *(F.bit_xor(y).over(earlier).alias(y) for y in ("ya", "yb")))
    whole = sums.join(before, ["conv_id", "stretch"], "left")
    return whole.select("conv_id", "depth", "length", "words", "xa", "xb", *(F.col(d).bitwiseXOR(F.coalesce(y, F.lit(0))).alias(d) for d, y in zip(DIGEST, ("ya", "yb"), strict=True)))


def slots(da: np.ndarray, db: np.ndarray, width: int, rows: int = ROWS) -> Iterator[np.ndarray]:
    """The counter of each digest in each row of a sketch, `width` (a power of two) counters a row."""
    a, b = da.view(np.uint64), db.view(np.uint64) | np.uint64(1)
    for k in range(rows):
        yield ((a + np.uint64(k) * b + ((a >> np.uint64(29)) ^ (b >> np.uint64(31)))) & np.uint64(width - 1)).astype(np.int64) + k * width


def sketch(digests: DataFrame, width: int, rows: int = ROWS) -> np.ndarray:
    """Packed bits of a count-min sketch of (da, db): whether each counter is over one.

    A task counts its rows up to two and sends on blocks of counters that are not all zero; blocks are merged by
    their number, one after another. One bit for each of rows * width counters reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(rows * width, np.uint8)
        for b in batches:
            for at in slots(b.column(0).to_numpy(), b.column(1).to_numpy(), width, rows):
                at, n = np.unique(at, return_counts=True)
                seen[at] = np.minimum(seen[at] + np.minimum(n, 2), 2)
        blocks = seen.reshape(-1, BLOCK)
        for k in blocks.any(axis=1).nonzero()[0].tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "counters": [blocks[k].tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int64()), "bits": [np.packbits(total > 1, bitorder="little").tobytes()]})

        now, total = -1, np.zeros(BLOCK, np.uint8)
        for b in batches:
            for k, counters in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != now and now >= 0:
                    yield done()
                    total = np.zeros(BLOCK, np.uint8)
                now, total = k, np.minimum(total + np.frombuffer(counters.as_buffer(), np.uint8), 2)
        if now >= 0:
            yield done()

    parts = max(2, int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = digests.select(*DIGEST).mapInArrow(count, "block long, counters binary")
    out = np.zeros(rows * width // 8, np.uint8)
    for k, bits in counted.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary").collect():
        out[k * BLOCK // 8 : (k + 1) * BLOCK // 8] = np.frombuffer(bits, np.uint8)
    return out


def screened(rows: DataFrame, width: int | None = None) -> DataFrame:
    """prefixes() with `shared` and `parent_shared`: false where the sketch proves that one conversation alone has the prefix, or its parent."""
    if width is None:
        width = min(MOST, max(LEAST, 1 << (4 * rows.count()).bit_length()))
    many = rows.sparkSession.sparkContext.broadcast(sketch(rows, width))

    def estimate(da: np.ndarray, db: np.ndarray) -> np.ndarray:
        out = np.ones(len(da), bool)
        for at in slots(da, db, width):
            out &= (many.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xa, xb, da, db = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("xa", "xb", "da", "db"))
            told = [pa.array(estimate(da, db)), pa.array(estimate(da ^ xa, db ^ xb))]
            yield pa.RecordBatch.from_arrays([*b.columns, *told], names=[*b.schema.names, "shared", "parent_shared"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{out}, shared boolean, parent_shared boolean")


def ends(members: DataFrame) -> DataFrame:
    """(da, db, ends_sha256) of (da, db, conv_id): the hash of the ids of each digest, ascending, comma-joined.

    Ids are sorted over all tasks and joined in pieces of IDS; only the pieces of a digest come to one task, where
    they are hashed as they pass.
    """
    parts = max(2, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, ids = (b.column(k).to_numpy() for k in range(3))
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (np.arange(1, len(a)) % IDS == 0)
            first = np.append(fresh.nonzero()[0], len(a))
            text = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"da": a[first[:-1]], "db": c[first[:-1]], "first": ids[first[:-1]], "ids": pa.array(text, pa.string())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, sha256()
        for b in batches:
            out = []
            for a, c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (a, c) == now:
                    state.update(b"," + text.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (a, c), sha256(text.encode())
            yield batch(out)
        if now is not None:
            yield batch([(*now, state.hexdigest())])

    def batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["da", "db", "ends_sha256"])

    key = [*DIGEST, "conv_id"]
    pieces = members.select(*key).repartitionByRange(parts, *key).sortWithinPartitions(*key).mapInArrow(join, "da long, db long, first long, ids string")
    return pieces.repartition(parts, *DIGEST).sortWithinPartitions(*DIGEST, "first").mapInArrow(digest, "da long, db long, ends_sha256 string")


def node(children: Column, leaves: Column, saved: Column, ends_: Column, parent: Column, n: Column) -> list[Column]:
    """The columns of a node after conv_id and depth."""
    return [parent.alias("parent_conv_id"), n.cast("long").alias("n_convs"), children.cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), ends_.alias("ends_sha256")]


def prefix_trie(turns: DataFrame, width: int | None = None) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of turns (conv_id, depth, length, role, text).

    `turns` is what grafted() makes: numbered from 1, with a row of depth 0 for each conversation. Two prefixes are one node if
    all roles and texts are equal. conv_id is the smallest conversation of a node; n_leaves and saved_tokens are sums over its
    subtree; ends_sha256 is the hash of the conversations that end there. `width` sets the sketch's counters in a row: it decides
    what moves, not what comes out. No turns give no nodes.
    """
    rows = kept(screened(written(prefixes(turns), "prefixes"), width))
    one, ended, alone = F.lit(1), F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)
    longer = F.when(ended, 0).otherwise(1)
    hashed = F.when(ended, alone).otherwise(F.lit(NOTHING))
    tails = rows.where("NOT shared AND NOT parent_shared").select("conv_id", "depth", *node(longer, one, F.lit(0), hashed, F.when(F.col("depth") > 0, F.col("conv_id")), one))

    some = rows.where("shared")
    groups = kept(some.groupBy(*DIGEST).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.sum(longer).alias("n_longer")))
    told = looked_up(some, groups, DIGEST, "n_convs")
    single = rows.where("NOT shared AND (parent_shared OR depth = length)").select("*", F.lit(1).cast("long").alias("n_convs"), F.col("conv_id").alias("owner"), longer.cast("long").alias("n_longer"))
    # a conversation's nodes that matter, by stretches; each stretch also sees, but doesn't count, the nodes next to it
    at = F.expr(f"depth div {STRETCH}")
    beside = F.when(F.col("depth") % STRETCH == STRETCH - 1, at + 1).when((F.col("depth") % STRETCH == 0) & (F.col("depth") > 0), at - 1)
    path = told.unionByName(single).withColumn("own", F.col("owner") == F.col("conv_id"))
    path = path.withColumn("stretch", F.explode(F.when(F.col("length") < STRETCH, F.array(at)).otherwise(F.array_compact(F.array(at, beside))))).withColumn("counts", F.col("stretch") == at)
    path = kept(path)
    mine = F.col("own") & F.col("counts")
    leaf = F.when(mine & (F.col("n_longer") == 0), 1).otherwise(0)
    saved = F.when(mine, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)
    inside = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    onward = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth"))
    near = lambda f, c: F.when(f("depth").over(inside) == F.col("depth") + (1 if f is F.lead else -1), f(c).over(inside))
    after = path.where(F.col("length") >= STRETCH).groupBy("conv_id", "stretch").agg(F.sum(leaf).alias("more_leaves"), F.sum(saved).alias("more_saved"))
    later = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(1, Window.unboundedFollowing)
    after = after.select("conv_id", "stretch", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("more_leaves", "more_saved")))
    summed = path.select(
        *path.columns,
        F.sum(leaf).over(onward).alias("leaves"),
        F.sum(saved).over(onward).alias("saved"),
        F.when(F.col("depth") > 0, F.coalesce(near(F.lag, "owner"), "conv_id")).alias("parent"),
        near(F.lead, "own").alias("child"),
    ).where("counts").join(after, ["conv_id", "stretch"], "left")
    leaves, saved = F.expr("leaves + coalesce(more_leaves, 0)"), F.expr("saved + coalesce(more_saved, 0)")
    summed = kept(summed.withColumn("leaves", leaves).withColumn("saved", saved))
    joints = summed.where("NOT shared AND parent_shared").select("conv_id", "depth", *node(longer, one, F.lit(0), hashed, F.col("parent"), one))
    nodes = summed.where("shared").groupBy(*DIGEST).agg(
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max(F.when(F.col("own"), F.col("parent"))).alias("parent"),
        F.count("*").alias("n"),
        F.count_if("child").alias("children"),
        F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
    )
    nodes = nodes.join(ends(some.where(ended)), DIGEST, "left")
    exact = nodes.select("conv_id", "depth", *node(F.col("children"), F.col("leaves"), F.col("saved"), F.coalesce("ends_sha256", F.lit(NOTHING)), F.col("parent"), F.col("n")))
    return tails.unionByName(joints).unionByName(exact)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without conv_id belong to no conversation; turns that are numbered alike are ordered by role, then text."""
    return prefix_trie(grafted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


ORACLE = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
j AS (
  SELECT c.conv_id, 0 AS own, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL SELECT c.conv_id, 1, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS depth, role, text FROM j
  UNION ALL SELECT conv_id, 0, NULL, NULL FROM c),
p AS (
  SELECT conv_id, depth, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, max(depth) OVER (PARTITION BY conv_id) AS length,
    sha256(string_agg(coalesce(sha256(role) || sha256(text), ''), '') OVER (PARTITION BY conv_id ORDER BY depth)) || '/' || depth AS name FROM r),
n AS (
  SELECT name, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, count(*) FILTER (length > depth) AS n_longer,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM p GROUP BY name),
o AS (SELECT n.*, q.name AS parent, m.conv_id AS parent_conv_id FROM n
  LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth
  LEFT JOIN p AS q ON q.conv_id = p.conv_id AND q.depth = p.depth - 1 LEFT JOIN n AS m ON m.name = q.name),
s AS (  -- a node is in the subtree of each prefix of its smallest conversation
  SELECT p.name, count(*) FILTER (n.n_longer = 0) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.name),
k AS (SELECT parent, count(*) AS n_children FROM o GROUP BY parent)
SELECT o.conv_id, o.depth, o.parent_conv_id, o.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM o JOIN s USING (name) LEFT JOIN k ON k.parent = o.name
"""
