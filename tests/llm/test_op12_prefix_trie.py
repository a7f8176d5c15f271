import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from compare import same

from rigtables.llm import op12_prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def test_query_equals_its_oracle(spark, duck, sf_dir):
    got, want = same(op.op12_prefix_trie(spark, sf_dir), duck, op.ORACLE)
    assert got == want


def brute(rows):
    """Nodes from all prefixes of all rebuilt conversations, as sets."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for name, who in members.items():
        below = [n for n in members if n[: len(name)] == name]
        ended = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(name))
        children = sum(len(n) == len(name) + 1 for n in below)
        leaves = sum(all(len(rebuilt[c]) == len(n) for c in members[n]) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in below if n)
        parent = min(members[name[:-1]]) if name else None
        out.append((min(who), len(name), parent, len(who), children, leaves, saved, sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a b", "c", "", None])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in (105, 106, 107, 109) for t in range(9)]  # copies, one of them below
    rows += [(109, 9, "user", "longer"), (120, None, "x", "first"), (120, 3, "b", "tie"), (120, 3, "a", "tie"), (120, 3, "a", "tie"), (121, 0, "u", "lone")]
    rows += [(None, 0, "user", "no conversation"), (7, 2, "user", "long " * 5000)]
    return rows


@pytest.mark.parametrize("stretch, ids", [(1 << 16, 1 << 12), (3, 2)])
def test_nodes_equal_brute_force_whatever_is_added_up_at_once(spark, monkeypatch, stretch, ids):
    monkeypatch.setattr(op, "STRETCH", stretch)
    monkeypatch.setattr(op, "IDS", ids)
    rows = conversations(stretch)
    turns = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = op.prefix_trie(op.grafted(turns)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_a_crowded_sketch_moves_more_but_finds_the_same(spark):
    rows = conversations(5)
    turns = op.written(op.grafted(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)), "turns")
    nodes = op.prefixes(turns).count()
    op_rows, width = op.prefixes(turns), op.BLOCK
    told = op.screened(op_rows, width).where("NOT shared").count()
    assert 0 < told < nodes
    crowded = np.full(3 * width // 8, 255, np.uint8)
    original, op.sketch = op.sketch, lambda *_: crowded  # every estimate says "perhaps more than one"
    try:
        got = op.prefix_trie(turns, width).collect()
    finally:
        op.sketch = original
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_no_turns_give_no_nodes(spark):
    assert op.prefix_trie(op.grafted(spark.createDataFrame([], SCHEMA))).count() == 0
