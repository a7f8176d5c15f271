import itertools
import math
import re
from collections import Counter

import pytest

from rigtables.llm import op9_quality as op


def slow_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, x in enumerate(grams) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_and_base(spark, sf_dir):
    rows = op.op9_quality(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = slow_counts(texts[r.doc_id])
        assert tuple(r[c] for c in COUNTS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_edge_texts(docs_of):
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "l\nl\n \nl", "é|日 $\x0b#", "w " * 150_000, "a\x0bb\x0cc\rd"]
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in op.weak_quality(docs_of(*texts)).collect()}
    assert got == {k: slow_counts(t) for k, t in enumerate(texts)}
    assert op.weak_quality(docs_of()).count() == 0


def test_expectation_maximisation_finds_planted_rules():
    """Documents drawn by known rates: the fit comes near them, and its posterior is Bayes' rule."""
    rates = [{0: [0.6, 0.2, 0.2], 1: [0.02, 0.08, 0.9]}, {0: [0.5, 0.3, 0.2], 1: [0.05, 0.05, 0.9]}, {0: [0.7, 0.1, 0.2], 1: [0.01, 0.19, 0.8]}, {0: [0.4, 0.2, 0.4], 1: [0.03, 0.02, 0.95]}]
    good, patterns = 0.8, []
    for p in itertools.product((-1, 0, 1), repeat=4):
        chance = sum(share * math.prod(r[c][v + 1] for r, v in zip(rates, p, strict=True)) for c, share in ((0, 1 - good), (1, good)))
        patterns.append((p, round(10**6 * chance)))
    share, found = op.fit_votes(patterns, prior=0.001)
    assert share == pytest.approx(good, abs=0.02)
    for a, b in zip(found, rates, strict=True):
        assert a[0] == pytest.approx(b[0], abs=0.05) and a[1] == pytest.approx(b[1], abs=0.03)
    bad, fine = ((1 - share) * math.prod(r[0][0] for r in found)), share * math.prod(r[1][0] for r in found)
    assert op.posterior((-1,) * 4, share, found) == pytest.approx(fine / (fine + bad))
    assert op.fit_votes([]) == (0.9, [])


def test_labelled_documents(spark, sf_dir):
    kept = {r.doc_id: r for r in op.op9_quality(spark, sf_dir).collect()}
    labels = [(kept[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in kept]
    fine = [k.kept for k, q in labels if q == 1 and not k.base_failed]
    assert sum(fine) / len(fine) > 0.97
    junk = [k.kept for k, q in labels if q == 0]
    assert sum(junk) / len(junk) < 0.5


def test_verdicts_by_bayes_over_all_rows(spark, sf_dir):
    """Votes counted again from the counts of every row; the verdict is the posterior of the fit over these patterns."""
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    rows, patterns = op.weak_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect(), {}
    for r in rows:
        n, c, lines = r.n_words, r.word_chars, r.n_lines
        mean = c / max(n, 1)
        patterns[r] = (
            vote(n >= 100, n < 50), vote(3.5 <= mean <= 9, mean < 2.5 or mean > 12 or n == 0), vote(r.n_symbols <= 0.02 * n, r.n_symbols > 0.1 * n),
            vote(r.n_dup_lines == 0 and lines >= 3, r.n_dup_lines > 0.3 * lines), vote(r.n_repeat_words <= 0.1 * n, r.n_repeat_words > 0.3 * n),
            vote(r.n_closed_lines >= 0.7 * lines, r.n_closed_lines < 0.3 * lines or lines == 0), vote(r.n_letters >= 0.85 * c, r.n_letters < 0.7 * c or c == 0),
        )
    good, rates = op.fit_votes(sorted(Counter(patterns.values()).items()))
    for r, p in patterns.items():
        q = op.posterior(p, good, rates)
        assert r.quality == pytest.approx(q) and r.kept == (not r.base_failed and q >= 0.5)
