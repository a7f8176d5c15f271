import numpy as np
import xxhash

from rigtables.llm import op1_simhash as op


def slow_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints):
    """(doc, component) by joining all pairs within two bits."""
    group = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints.items():
            for b, y in prints.items():
                if (x ^ y).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


def test_fingerprints(spark, sf_dir):
    for t in (None, "", " \t", "One", "a b", "A b  c\nd", "é É x y z", "a a a a a a"):
        assert op.fingerprint(t) == slow_print(t)
    long = " ".join(str(k % 977) for k in range(5000))
    assert op.fingerprint(long) == op.fingerprint(long, step=7) == slow_print(long)
    rows = op.op1_simhash(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: slow_print(t) for d, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == slow_groups(prints)


def test_links_lose_none_in_crowds(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))]
    fps = sorted({*map(int, base), *near, *(k << 40 for k in range(300))})
    prints = dict(enumerate(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), d) for d, f in prints.items()], "fp long, rep long")
    want = slow_groups(prints)
    for crowd, m in ((2, 3), (1000, 3), (2, 2), (1000, 2)):
        linked = {r.node: r.component for r in op.connected_components(op.links(df, m=m, crowd=crowd)).collect()}
        assert {d: linked.get(d, d) for d in prints} == want


def test_groups_grow_with_the_corpus():
    assert [op.groups_for(n, 2) for n in (10, 10**6, 10**9, 10**10)] == [3, 3, 2, 2]


def test_thresholds_add_up():
    rng = np.random.default_rng(1)
    t = op.allocate(rng.uniform(0, 100, (50, 3, 3)).cumsum(axis=2), [22, 21, 21], 2)
    assert (t.sum(axis=1) == 0).all() and t.min() >= -1 and len(np.unique(t, axis=0)) > 1


def test_edge_rows(docs_of):
    texts = [None, "", "same words here now", "same words here now", "same words here now", "x" * 300_000]
    got = {(r.doc_id, r.component_id) for r in op.simhash_groups(docs_of(*texts, ids=[5, 6, 9, 7, 7, None])).collect()}
    assert {(5, 5), (6, 5), (9, 7), (7, 7)} <= got and len(got) == 5
    assert op.simhash_groups(docs_of()).count() == 0
