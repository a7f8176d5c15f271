import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rigtables.llm import op7_language as op


def slow_grams(text):
    c = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f" {w} "
        c.update(x for n in (1, 2, 3) for x in (w[i : i + n] for i in range(len(w) - n + 1)) if x != " ")
    return c


def spelled(code):
    return "".join(chr(code >> s & 0x1FFFFF) for s in (42, 21, 0) if code >> s & 0x1FFFFF)


def test_grams():
    for t in ("", "One two,two", "ÄÖ\n\n7 x_y", "a", "日本 語", "tab\tab"):
        for step in (1 << 20, 3):
            codes, n = op.grams(t, step)
            assert {spelled(int(c)): int(k) for c, k in zip(codes, n, strict=True)} == slow_grams(t), t
    codes, _ = op.grams(None)
    assert len(codes) == 0


def test_distance_by_hand(docs_of):
    profiles = {"x": sorted(map(code, ("a", " a", "b"))), "y": [code("b"), code("a")]}
    (r,) = op.predict(docs_of("b"), profiles, top=10).collect()
    own = [spelled(int(c)) for c in op.profile(*op.grams("b"))]
    away = {k: sum(abs(p.index(code(g)) - i) if code(g) in p else 10 for i, g in enumerate(own)) for k, p in profiles.items()}
    assert r.lang_pred == min(away, key=away.get) and abs(r.score - (1 - min(away.values()) / (10 * len(own)))) < 1e-12


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_held_out_accuracy(spark, sf_dir):
    rows = op.op7_language(spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def ranked(counts, top=op.TOP):
    """N-grams by frequency, then by their characters from the last place on, as the codes order them."""
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]


def test_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs}
    total = defaultdict(Counter)
    for r in docs:
        if not held[r.doc_id] and r.lang is not None:
            total[r.lang].update(slow_grams(r.text or ""))
    place = {lang: {g: k for k, g in enumerate(ranked(n))} for lang, n in total.items()}
    got = {r.doc_id: r for r in op.op7_language(spark, sf_dir).collect()}
    assert got.keys() == held.keys()
    for r in docs:
        own = ranked(slow_grams(r.text or ""))
        away = {lang: sum(abs(p[g] - k) if g in p else op.TOP for k, g in enumerate(own)) for lang, p in place.items()}
        best = min(sorted(away), key=away.get) if own else "und"
        g = got[r.doc_id]
        assert (g.held_out, g.lang_pred) == (held[r.doc_id], best)
        assert abs(g.score - (max(0.0, 1 - away[best] / (op.TOP * len(own))) if own else 0)) < 1e-9


def test_rows_without_id_are_learned_from(docs_of):
    df = docs_of("the cat", ids=[None])
    assert [r[0] for r in df.select(op.held_out()).collect()] == [False]


def test_edges(spark, docs_of):
    texts = ["the cat and the dog", None, "", "123 !!", "the " * 200_000, "the cat and the dog"]
    df = docs_of(*texts).withColumn("score", F.lit("clash"))
    profiles = op.learn_profiles(df)
    got = [(r.doc_id, r.lang_pred) for r in op.predict(df, profiles).orderBy("doc_id").collect()]
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en")]
    assert [r.lang_pred for r in op.predict(docs_of("text"), {}).collect()] == ["und"]
    assert op.learn_profiles(docs_of()) == {} and op.predict(docs_of(), profiles).count() == 0
    kept = op.in_known_language(df)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5] and kept.columns == df.columns
