import random
import zlib
from hashlib import sha256

import pytest
from compare import same
from pyspark.sql import functions as F

from rigtables.llm import op13_manifest as op

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at string, tree string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def test_query_equals_its_oracle(spark, duck, sf_dir):
    got, want = same(op.op13_manifest(spark, sf_dir), duck, op.ORACLE)
    assert got == want


def leaf(r):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def path(tree, at):
    """(sibling or none, whether it is to the left) of each level below the top."""
    return [(nodes[at >> k ^ 1] if (at >> k ^ 1) < len(nodes) else "", at >> k & 1) for k, nodes in enumerate(tree[:-1])]


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: levels([leaf(r) for r in of[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for at, r in enumerate(of[g]):
            way = path(trees[g], at) + path(top, k)
            new = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now = leaf((*r[:3], r[3] + 1, r[4])) if new else leaf(r)
            for other, left in way:
                now = digest(other, now) if left else digest(now, other)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], digest(*(o for o, _ in way)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [10, 2])
def test_rows_equal_brute_force_whatever_a_block_holds(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(op, "BITS", bits)
    rng = random.Random(bits)
    rows = [(k, rng.choice(["s", None]), rng.choice(["en", "en", "de", None]), rng.choice([k, None]), f"ж{k}") for k in range(90)]
    rows += [(33, "s", "en", 1, "copy")] * 3 + [(None, "s", "en", 2, None), (5000, None, "", 0, ""), (7, "s", "é", (1 << 63) - 1, "x" * 300_000)]
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op.op13_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    made = op.written(op.manifest(docs, F.col("doc_id") == 33, {"text": F.lit("other")}), "manifest")
    nodes = op.versions(made).collect()
    ways = {(r.doc_id, r.lang): op.height(r.n) + op.height(r.lang_n) for r in made.where("changed IS NOT NULL").collect()}
    assert {r.doc_id for r in nodes} == {33}
    assert all(sum(r.lang == lang for r in nodes) % (steps + 1) == 0 for (_, lang), steps in ways.items())  # the leaf and its ancestors alone


@pytest.mark.parametrize("rows", [0, 1])
def test_few_rows(spark, tmp_path, rows):
    spark.createDataFrame([(3, "s", None, 1, "t", "", "")][:rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op.op13_manifest(spark, str(tmp_path)).collect()]
    assert got == brute([(3, "s", None, 1, "t")][:rows])
