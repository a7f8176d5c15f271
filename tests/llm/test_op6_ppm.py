import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rigtables.llm import op6_ppm as op


def model(texts, order=op.ORDER):
    n = defaultdict(Counter)
    for t in texts:
        b = [*(t or "").encode(), 256]
        for i, y in enumerate(b):
            for o in range(min(i, order) + 1):
                n[tuple(b[i - o : i])][y] += 1
    return n


def slow_score(n, text, order=op.ORDER):
    b, total = [*(text or "").encode(), 256], 0.0
    for i, y in enumerate(b):
        gone = set()
        for o in range(min(i, order), -1, -1):
            c = n.get(tuple(b[i - o : i]))
            if not c:
                continue
            left, kinds = sum(v for q, v in c.items() if q not in gone), sum(q not in gone for q in c)
            if y in c:
                total += math.log10(c[y] / (left + kinds))
                break
            if kinds:
                total += math.log10(kinds / (left + kinds))
            gone |= set(c)
        else:
            total -= math.log10(257 - len(gone))
    return total


TRAIN = ["abracadabra", "abra cadabra", "", None, "ab", "日本語", "abracadabra"]
ASKED = ["abrac", None, "", "zebra", "日本", "cadabra abra \0"]


@pytest.mark.parametrize("share", [op.GRAM_SHARE, 20, 0])
@pytest.mark.parametrize("train", [TRAIN, ["ab"], []])
def test_scores_whatever_each_task_knows(spark, share, train):
    training = spark.createDataFrame([(t,) for t in train], "text string")
    rows = spark.createDataFrame(list(enumerate(ASKED)), "row long, text string")
    got = {r.row: r.score for r in op.ppm_scores(rows, training, share=share).collect()}
    n = model(train)
    assert got == pytest.approx({k: slow_score(n, t) for k, t in enumerate(ASKED)})


def test_symbols_of_a_context_add_up_to_one():
    n = model(TRAIN)
    ctx = "abra"
    # scores of all one-symbol continuations, the end included
    prefix = sum_prefix(n, ctx)
    total = 10 ** (slow_score(n, ctx) - prefix)
    total += sum(10 ** (sum_prefix(n, None, [*ctx.encode(), k]) - prefix) for k in range(256))
    assert total == pytest.approx(1)


def sum_prefix(n, text, symbols=None):
    """log10 probability of the symbols without the end."""
    b = symbols or [*text.encode()]
    whole, total = b, 0.0
    for i in range(len(whole)):
        gone, y = set(), whole[i]
        for o in range(min(i, op.ORDER), -1, -1):
            c = n.get(tuple(whole[i - o : i]))
            if not c:
                continue
            left, kinds = sum(v for q, v in c.items() if q not in gone), sum(q not in gone for q in c)
            if y in c:
                total += math.log10(c[y] / (left + kinds))
                break
            if kinds:
                total += math.log10(kinds / (left + kinds))
            gone |= set(c)
        else:
            total -= math.log10(257 - len(gone))
    return total


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    c = Counter()
    for d, t in texts.items():
        if not held[d]:
            c.update([*t.encode().lower().split(), b"\n"])
    n, v = sum(c.values()), len(c)
    trained = model(t for d, t in texts.items() if not held[d])
    rows = op.op6_ppm(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = [*texts[r.doc_id].encode().lower().split(), b"\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[t] > 0 for t in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w))
        if r.doc_id % 10 == 0:
            assert r.score == pytest.approx(slow_score(trained, texts[r.doc_id]))


def test_edges(docs_of):
    texts = ["a b a", None, "", "c " * 200_000, "a b a"]
    got = op.lm_scores(docs_of(*texts, ids=[1, 2, 3, 4, 1]), F.col("doc_id") == 3).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in got) == [(1, 4, 4), (1, 4, 4), (2, 1, 1), (3, 1, 1), (4, 200_001, 200_001)]
    assert op.lm_scores(docs_of(), F.lit(False)).count() == 0
    (one,) = op.lm_scores(docs_of("xy"), F.lit(True)).collect()
    assert (one.n_known, one.train_tokens) == (0, 0) and one.score == pytest.approx(-3 * math.log10(257))


def test_windows_cut_long_texts():
    texts = ["abcdefghij" * 3, None, "x", "é" * 9]
    whole = [(o.tolist(), c.tolist()) for o, c in op.windows(texts)]
    for step in (1, 2, 3, 7, 10, 30, 31):
        some = [(o.tolist(), c.tolist()) for o, c in op.windows(texts, step=step)]
        assert [sum((s[k] for s in some), []) for k in (0, 1)] == [sum((s[k] for s in whole), []) for k in (0, 1)]
