import random

import numpy as np

from rigtables.llm import op5_decontaminate as op


def distance(pattern, text):
    """Fewest edits between the pattern and any stretch of the text, by the whole table."""
    cost = np.zeros(len(text) + 1, int)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(cost[j - 1] + (p != t), cost[j] + 1, new[j - 1] + 1))
        cost = np.array(new)
    return int(cost.min())


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice("abcxyz")
        elif kind == 1:
            out.insert(k, rng.choice("abcxyz"))
        elif len(out) > 1:
            del out[k]
    return "".join(out)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


def test_finds_what_the_whole_table_finds():
    rng = random.Random(1)
    items = [(k, words(rng, n)) for k, n in enumerate((3, 6, 12, 25, 40, 60))] + [(6, "short"), (7, None), (8, "")]
    index = op.Index(items)
    texts = []
    for k, item in items[:6] * 6:
        texts.append(words(rng, rng.randint(0, 15)) + " " + edited(rng, item, rng.randint(0, len(item) // 8)) + " " + words(rng, rng.randint(0, 15)))
    texts += [words(rng, 40), "", items[3][1][:60]]
    plain = [op.plain(t) for t in texts]
    for text, found in zip(plain, index.found(plain), strict=True):
        got = {w: e for _, w, e in found}
        for w, pattern in enumerate(index.texts):
            d = distance(pattern.tolist(), text)
            assert got.get(w) == (d if d <= index.edits[w] else None)
    op_hits = op.HITS
    try:
        op.HITS = 7  # slices as short as they may be
        assert index.found(plain) == [sorted(f, key=lambda x: x[1]) for f in index.found(plain)]
        small = index.found(plain)
    finally:
        op.HITS = op_hits
    assert small == index.found(plain)


def test_long_runs_take_bounded_memory():
    import tracemalloc

    index = op.Index([(1, "a" * 400), (2, "ab" * 100)])
    tracemalloc.start()
    found = index.found([b"a" * 300_000, b"b" + b"ab" * 150_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {f[0] for f in found[0]} == {1} and 2 in {f[0] for f in found[1]} and peak < 250 << 20


def test_excerpts_wherever_they_begin():
    rng = random.Random(4)
    item = op.plain(words(rng, 80))
    index = op.Index([(1, item.decode())])
    n = op.WINDOW + op.STRIDE - 1
    texts = [op.plain(f"{words(rng, 9)} ") + b" " + item[k : k + n] + b" " + op.plain(words(rng, 9)) for k in range(0, len(item) - n)]
    assert all(index.found(texts))


def test_rows_blocks_and_edges(spark, docs_of):
    rng = random.Random(2)
    item = words(rng, 30)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny"), (4, item.upper()), (None, "x" * 30), (5, "")], "item_id long, text string")
    texts = [f"before {item} after", None, "", words(rng, 20_000), words(rng, 5000) + item.replace(" ", "\n\n").title(), item[: len(item) // 3], "Tiny!", "so tiny", "X" * 31]
    df = docs_of(*texts, ids=[10, 11, 12, 13, 14, 15, 16, 17, 18])
    for size in (1 << 20, 50):
        got = {(r.doc_id, r.item_id): r.edits for r in op.contaminated(df, bench, size).collect()}
        assert got == {(d, i): 0 for d in (10, 14) for i in (1, 4)} | {(16, 3): 0, (18, None): 0}
        clean = op.decontaminate(df, bench, size)
        assert sorted(r.doc_id for r in clean.collect()) == [11, 12, 13, 15, 17] and clean.columns == df.columns
    assert op.contaminated(docs_of(), bench).count() == 0
    assert op.contaminated(df, bench.limit(0)).count() == 0 and op.decontaminate(df, bench.limit(0)).count() == 9


def test_query_by_brute_force(spark, sf_dir):
    """Every window against every text by the whole table; first by how many q-grams they share, in any order, which an honest match needs."""
    docs, bench = ({r[0]: op.plain(r[1]) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()} for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r.doc_id, r.item_id): (r.windows, r.edits) for r in op.op5_decontaminate(spark, sf_dir).collect()}
    grams = {d: {t[k : k + op.Q] for k in range(len(t) - op.Q + 1)} for d, t in docs.items()}
    want = {}
    for i, b in bench.items():
        for w in op.windows(b):
            k = op.budget(len(w))
            own = [w[j : j + op.Q] for j in range(len(w) - op.Q + 1)]
            for d, t in docs.items():
                if sum(x in grams[d] for x in own) >= len(w) + 1 - (k + 1) * op.Q:
                    e = 0 if w in t else distance(w, t)
                    if e <= k:
                        n, best = want.get((d, i), (0, k))
                        want[d, i] = (n + 1, min(best, e))
    assert want and got == want
