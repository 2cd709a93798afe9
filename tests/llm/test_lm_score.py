"""Automaton scores against a direct computation."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from civicspark.llm import lm_score


def brute(rows, mu=(200.0, 50.0)):
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) + ["\0end"]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    runs, texts = Counter(), 0
    for i, t in rows:
        if not held(i):
            w = ["\0start", *tok(t)]
            texts += 1
            runs.update(tuple(w[j - n : j]) for n in range(1, 5) for j in range(n, len(w) + 1))
    start = ("\0start",)
    total = sum(c for r, c in runs.items() if len(r) == 1) - texts
    types = sum(len(r) == 1 for r in runs) - (start in runs)

    def p(context, x):
        if not context:
            return (runs[x,] + 0.1) / (total + 0.1 * (types + 1))
        m = mu[len(context) - 1]
        return (runs[*context, x] + m * p(context[1:], x)) / (runs[context] + m)

    out = {}
    for i, t in rows:
        w = ["\0start", *tok(t)]
        places = range(1, len(w))
        out[i] = (held(i), len(w) - 1, sum(runs[w[j],] > 0 for j in places), total, sum(math.log10(p((), w[j])) for j in places), sum(math.log10(p(tuple(w[max(0, j - len(mu)) : j]), w[j])) for j in places))
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300, "part_bytes": 500, "mu": (200.0, 50.0, 20.0)}])
def test_scores(spark, options):
    rng = random.Random(6)
    vocab = ["a", "b", "Cd", "é"]
    rows = [(i, t) for i, t in enumerate(["The cat sat", "the cat ran", "", None, "a  dog\n ran É é", "THE dog", "x" * 5000, "the " * 500] * 5)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    df = df.union(spark.createDataFrame([(1000 + i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30))), 1) for i in range(120)], df.schema))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in lm_score.score_texts(df, **options).collect()}
    for i, want in brute(rows, options.get("mu", (200.0, 50.0))).items():
        assert got[i][:4] == want[:4] and got[i][4:] == pytest.approx(want[4:])


def test_no_rows(spark):
    assert lm_score.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weights_leaving_a_state_sum_to_one():
    total, types, mu = 100, 7, 8.0
    counts = [40, 30, 20, 5, 3, 1, 1]
    root = [(c + 0.1) / (total + 0.1 * (types + 1)) for c in [*counts, 0]]
    arcs = [3, 0, 2, 0, 0, 0, 0, 0]
    assert sum((a + mu * p) / (sum(arcs) + mu) for a, p in zip(arcs, root, strict=True)) == pytest.approx(1)
