"""A Merkle manifest of a data set, as a persistent tree: changed leaves make versions that share what they don't change.

Leaves of a tree are cut into aligned blocks of 2^BITS. A block hashes its nodes once, keeps each leaf's siblings,
and copies, for each changed leaf, that leaf's ancestors inside the block: a version of its own, sharing all other
nodes. Block roots are the leaves of the next blocks, and so on up, over all tasks; each version goes on through the
siblings of its block's root. A node of one child is hashed too, and trees end where one node remains.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigtables.llm.common import crc32_sql, in_order, kept, looked_up, table, written

BITS, EVERY = 10, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALL = "all"


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


def above(left: bytes, right: bytes = b"") -> bytes:
    return sha256((left.hex() + right.hex()).encode()).digest()


def has_sibling(at: int, level: int, n: int) -> bool:
    """Whether the ancestor at `level` of leaf `at` of n has a sibling."""
    return (at >> level ^ 1) < -(-n >> level)


def climb(digest: bytes, at: int, n: int, siblings: bytes, first: int, levels: int) -> tuple[list[bytes], bytes]:
    """(the ancestors of leaf `at` of n at levels first + 1 and on, what is left of `siblings`), from its ancestor at level `first`."""
    out = []
    for level in range(first, first + levels):
        if has_sibling(at, level, n):
            other, siblings = siblings[:32], siblings[32:]
            digest = above(other, digest) if at >> level & 1 else above(digest, other)
        else:
            digest = above(digest)
        out.append(digest)
    return out, siblings


def block_nodes(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """The levels of a block, leaves first."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([above(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return out


def blocks(nodes: DataFrame, changed: bool) -> DataFrame:
    """(tree, block, at, n, name, leaf, changed, siblings, root, copies) of nodes (tree, at, n, name, leaf, [changed]).

    `at` is a node's place among the n of its tree. `siblings` are those inside the block, `root` is the block's;
    `copies` are the ancestors that a changed leaf copies there, its version of the root last.
    """

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("at")
        at, n, leaves = batch["at"].to_pylist(), batch["n"][0].as_py(), batch["leaf"].to_pylist()
        levels = min(BITS, height(n))
        tree, base = block_nodes(leaves, levels), at[0]
        siblings, copies = [], []
        new = batch["changed"].to_pylist() if changed else [None] * len(at)
        for k, (a, other) in enumerate(zip(at, new, strict=True)):
            siblings.append(b"".join(tree[j][k >> j ^ 1] for j in range(levels) if has_sibling(a, j, n)))
            copies.append(b"".join(climb(other, a, n, siblings[-1], 0, levels)[0]) if other is not None else None)
        return pa.table({
            "tree": batch["tree"], "block": pa.array([base >> BITS] * len(at), pa.int64()), "at": batch["at"], "n": batch["n"], "name": batch["name"], "leaf": batch["leaf"],
            "changed": pa.array(new, pa.binary()), "siblings": pa.array(siblings, pa.binary()), "root": pa.array([tree[-1][0]] * len(at), pa.binary()), "copies": pa.array(copies, pa.binary()),
        })

    out = "tree string, block long, at long, n long, name long, leaf binary, changed binary, siblings binary, root binary, copies binary"
    named = nodes if changed else nodes.withColumn("changed", F.lit(None).cast("binary"))
    return named.groupBy("tree", F.shiftright("at", BITS).alias("block")).applyInArrow(run, out)


def upper_paths(nodes: DataFrame, most: int) -> DataFrame:
    """(tree, at, siblings, top) of nodes (tree, at, n, leaf): all siblings up to the tree's root `top`. `most` is the most that a tree has."""
    made = written(blocks(nodes.withColumn("name", F.lit(None).cast("long")), False), "nodes")
    if most <= 1 << BITS:
        return made.select("tree", "at", "siblings", F.col("root").alias("top"))
    up = upper_paths(roots(made), -(-most >> BITS))
    up = up.select("tree", F.col("at").alias("block"), F.col("siblings").alias("more"), "top")
    return written(made.join(up, ["tree", "block"]).select("tree", "at", F.concat("siblings", "more").alias("siblings"), "top"), "paths")


def roots(made: DataFrame) -> DataFrame:
    """Block roots as the nodes (tree, at, n, leaf) of the next level."""
    once = made.where(F.col("at") % (1 << BITS) == 0)
    return once.select("tree", F.col("block").alias("at"), F.shiftright(F.col("n") + ((1 << BITS) - 1), BITS).alias("n"), F.col("root").alias("leaf"))


def leaf_text(values: dict[str, Column]) -> Column:
    """What a leaf is the hash of: each value's UTF-8 length, a colon and the value; `-` for null."""
    text = [v.cast("string") for v in values.values()]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text))


def leaves(docs: DataFrame, tampered: Column, change: dict[str, Column]) -> DataFrame:
    """(doc_id, lang, leaf, changed): leaf digests, and those of rows with `change` in place of their values where `tampered`."""
    own = {c: F.col(c) for c in FIELDS}
    digest = lambda values: F.unhex(F.sha2(leaf_text(values), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), digest(own).alias("leaf"), F.when(tampered, digest(own | change)).alias("changed"))


def manifest(docs: DataFrame, tampered: Column, change: dict[str, Column]) -> DataFrame:
    """For each row of docs (doc_id, source, lang, n_chars, text): where its leaf is, its siblings up to the root, and its version.

    (doc_id, lang, at, n, leaf, changed, siblings, copies, subroot, lang_at, lang_n, upper, root): `siblings` are those of its block,
    `upper` the rest up to the root, both 32 bytes each; `copies` are the nodes that the version of a changed leaf has of its own
    inside the block. There is a tree for each lang (null is one, the first), and one of their roots. Rows of one lang and doc_id are
    ordered by leaf; repeated rows are leaves each. No rows give none; other columns are ignored.
    """
    made = written(leaves(docs, tampered, change), "leaves")
    one = F.lit(1).cast("long").alias("one")
    ordered = in_order(made.select("*", one, F.monotonically_increasing_id().alias("row")), ["lang", "doc_id", "leaf", "row"], "one", "leaves")
    # null comes first and has a name of its own
    ordered = ordered.select("*", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"))
    langs = kept(ordered.groupBy("tree").agg(F.min("start").alias("first"), F.count("*").alias("n"), F.min("lang").alias("lang")))
    spot = looked_up(ordered, langs.select("tree", "first", "n"), ["tree"], "n")
    base = written(blocks(spot.select("tree", (F.col("start") - F.col("first")).alias("at"), "n", F.col("doc_id").alias("name"), "leaf", "changed"), True), "blocks")
    most = langs.agg(F.max("n")).first()[0] or 0
    upper = upper_paths(kept(roots(base)), -(-most >> BITS))
    tops = kept(upper.where("at = 0").select("tree", "top"))
    ranked = in_order(tops.join(langs, "tree").select("tree", "lang", "n", F.col("top").alias("leaf"), one), ["lang", "tree"], "one", "langs")
    ranked = kept(ranked.select("tree", "lang", F.col("n").alias("rows"), F.col("leaf").alias("subroot"), F.col("start").alias("lang_at")))
    count = ranked.count()
    final = upper_paths(kept(ranked.select(F.lit(ALL).alias("tree"), F.col("lang_at").alias("at"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("leaf"))), count)
    final = final.select(F.col("at").alias("lang_at"), F.col("siblings").alias("last"), F.col("top").alias("root"))
    found = kept(ranked.join(final, "lang_at").withColumn("lang_n", F.lit(count).cast("long")))
    # one path for each block, and with it that of its lang
    per_block = kept(upper.select("tree", F.col("at").alias("block"), F.col("siblings").alias("more")))
    whole = looked_up(per_block, found, ["tree"], "rows")
    whole = whole.select("tree", "block", "lang", F.concat("more", "last").alias("upper"), "subroot", "lang_at", "lang_n", F.col("root").alias("top"))
    return base.join(whole, ["tree", "block"]).select(F.col("name").alias("doc_id"), "lang", "at", "n", "leaf", "changed", "siblings", "copies", "subroot", "lang_at", "lang_n", "upper", F.col("top").alias("root"))


Row = dict[str, object]


def _along(rows: DataFrame, make: Callable[[Row], Row], out: str, columns: list[str]) -> DataFrame:
    """rows with what `make` says of each, in batches."""
    fields = [f.strip().rsplit(" ", 1) for f in out.split(",")]
    kinds = {"binary": pa.binary(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [make(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in columns), *(pa.array([g[n] for g in got], kinds[t]) for n, t in fields)], names=[*columns, *(n for n, _ in fields)])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{schema}, {out}")


def version_nodes(row: Row, bits: int) -> list[bytes]:
    """The nodes that a leaf's version copies, from the leaf's parent to the root; of an unchanged leaf, those that it shares."""
    at, n = row["at"], row["n"]
    inside, levels = min(bits, height(n)), height(n)
    if row["changed"] is not None:
        copies = [row["copies"][k : k + 32] for k in range(0, len(row["copies"]), 32)]
    else:
        copies = climb(row["leaf"], at, n, row["siblings"], 0, inside)[0]
    now = copies[-1] if copies else row["changed"] or row["leaf"]
    more, rest = climb(now, at, n, row["upper"], inside, levels - inside)
    now = more[-1] if more else now
    return copies + more + climb(now, row["lang_at"], row["lang_n"], rest, 0, height(row["lang_n"]))[0]


def versions(rows: DataFrame) -> DataFrame:
    """(doc_id, lang, level, digest): the nodes that each changed leaf's version has of its own, the leaf at level 0; all others it shares."""
    bits = BITS
    changed = _along(rows.where("changed IS NOT NULL"), lambda r: {"nodes": [r["changed"], *version_nodes(r, bits)]}, "nodes array<binary>", ["doc_id", "lang"])
    return changed.select("doc_id", "lang", F.posexplode("nodes").alias("level", "digest"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    rows = manifest(docs, F.coalesce(tampered, F.lit(False)), {"n_chars": more})

    bits = BITS

    def fold(r: Row) -> Row:
        nodes = version_nodes(r, bits)
        return {"folded": nodes[-1] if nodes else r["changed"] or r["leaf"]}

    folded = _along(rows, fold, "folded binary", ["doc_id", "leaf", "siblings", "upper", "subroot", "root"])
    hexed = lambda c: F.lower(F.hex(c))
    return folded.select(
        "doc_id",
        hexed("leaf").alias("leaf"),
        hexed("subroot").alias("subroot"),
        hexed("root").alias("root"),
        F.sha2(hexed(F.concat("siblings", "upper")), 256).alias("proof_sha256"),
        hexed("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _leaf_sql(n_chars: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT *, {_leaf_sql("CAST(n_chars AS VARCHAR)")} AS leaf,
    CASE WHEN coalesce({crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) THEN {_leaf_sql("CAST(n_chars + 1 AS VARCHAR)")} END AS changed
  FROM documents),
l AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, lang, leaf, coalesce(changed, leaf) AS now,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
n AS (  -- nodes of the trees of each lang
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (min(n) + 1) // 2
  FROM n WHERE n > 1 GROUP BY tree, level, pos // 2),
s AS (
  SELECT n.tree, n.level AS height, n.digest AS subroot, row_number() OVER (ORDER BY g.lang NULLS FIRST) - 1 AS lang_at
  FROM n JOIN (SELECT DISTINCT tree, lang FROM l) AS g USING (tree) WHERE n.n = 1),
m AS (  -- nodes of the tree of their roots
  SELECT 0 AS level, lang_at AS pos, subroot AS digest, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (min(n) + 1) // 2 FROM m WHERE n > 1 GROUP BY level, pos // 2),
p AS (  -- siblings of each leaf, by step
  SELECT l.tree, l.pos, n.level AS step, n.digest, (l.pos >> n.level) % 2 = 1 AS to_left
  FROM l JOIN n ON n.tree = l.tree AND n.pos = xor(l.pos >> n.level, 1) AND n.n > 1
  UNION ALL
  SELECT l.tree, l.pos, s.height + m.level, m.digest, (s.lang_at >> m.level) % 2 = 1
  FROM l JOIN s USING (tree) JOIN m ON m.pos = xor(s.lang_at >> m.level, 1) AND m.n > 1),
h AS (SELECT max(level) AS height FROM m),
f AS (
  SELECT l.tree, l.pos, 0 AS step, l.now AS digest FROM l
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1, sha256(CASE WHEN p.digest IS NULL THEN f.digest WHEN p.to_left THEN p.digest || f.digest ELSE f.digest || p.digest END)
  FROM f JOIN s USING (tree) CROSS JOIN h LEFT JOIN p ON p.tree = f.tree AND p.pos = f.pos AND p.step = f.step
  WHERE f.step < s.height + h.height),
q AS (SELECT tree, pos, sha256(string_agg(digest, '' ORDER BY step)) AS proof_sha256 FROM p GROUP BY tree, pos)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
  f.digest AS folded_root, f.digest = r.digest AS verified
FROM l JOIN s USING (tree) CROSS JOIN h JOIN m AS r ON r.n = 1
  JOIN f ON f.tree = l.tree AND f.pos = l.pos AND f.step = s.height + h.height
  LEFT JOIN q ON q.tree = l.tree AND q.pos = l.pos
"""
