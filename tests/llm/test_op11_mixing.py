import hashlib
import math
import re

import pytest
from compare import same

from rigtables.llm import op11_mixing as op

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def test_query_equals_its_oracle(spark, duck, sf_dir):
    got, want = same(op.op11_mixing(spark, sf_dir), duck, op.ORACLE)
    assert got == want


def brute_targets(sizes, weights, share, most):
    """Targets by the rounds of the contract: cap what is above, share the excess among the rest."""
    total, full = share * sum(sizes), set()
    while True:
        rest = [k for k in range(len(sizes)) if k not in full]
        level = (total - sum(most * sizes[k] for k in full)) / max(1, sum(weights[k % len(weights)] for k in rest))
        over = {k for k in rest if weights[k % len(weights)] * level > most * sizes[k]}
        if not over:
            return [most * sizes[k] if k in full else weights[k % len(weights)] * level for k in range(len(sizes))]
        full |= over


def brute(rows, weights=op.WEIGHTS, share=op.SHARE, most=op.MOST, seed=op.SEED):
    sources = sorted({r[1] for r in rows if r[1] is not None}) + [None] * any(r[1] is None for r in rows)
    size = [len(WORD.findall(r[2] or "")) for r in rows]
    of = [sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in sources]
    out = []
    for s, total, target in zip(sources, of, brute_targets(of, weights, share, most), strict=True):
        place = lambda k: int(hashlib.md5(f"{seed}:{'' if rows[k][0] is None else rows[k][0]}:{size[k]}".encode()).hexdigest()[:15], 16)
        left = math.floor(target) - (whole := math.floor(target) // total if total else 0) * total
        for k in sorted((k for k in range(len(rows)) if rows[k][1] == s), key=lambda k: (place(k), rows[k][0] or 0, size[k])):
            out.append((rows[k][0], size[k], total, round(target, 6), whole * size[k] + (more := min(left, size[k]))))
            left -= more
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [1 << 16, 2])
def test_plan_equals_brute_force_whatever_is_ordered_at_once(spark, monkeypatch, group):
    monkeypatch.setattr(op, "GROUP", group)
    text = lambda n: "\t ".join(["ж"] * n) + "\n"
    rows = [(k, "big", text(k % 7)) for k in range(40)] + [(100, "big", text(3))] * 20 + [(None, "big", text(2))] * 3
    rows += [(200, None, text(50)), (201, None, None), (202, "a", ""), (203, "none", None), (204, "é", text(900)), (205, "z", text(5)), (206, "z", text(5))]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, source string, text string, place string, size long")
    plan = op.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in plan), key=str) == brute(rows)


def test_mix_holds_what_the_plan_takes(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], " ".join(f"w{k}-{i}" for i in range(k)), "en") for k in range(9)], "doc_id long, source string, text string, lang string")
    taken = {r.doc_id: r.taken for r in op.mix_plan(docs).collect()}
    mix = op.mixed(docs).collect()
    assert {k: sum(len(r.text.split()) for r in mix if r.doc_id == k) for k in taken} == taken
    assert all(r.text == " ".join(f"w{r.doc_id}-{i}" for i in range(len(r.text.split()))) for r in mix) and mix[0].lang == "en"
    none = docs.limit(0)
    assert op.mix_plan(none).count() == 0 and op.mixed(none).count() == 0
    with pytest.raises(ValueError):
        op.mix_plan(docs, share=3.0)
