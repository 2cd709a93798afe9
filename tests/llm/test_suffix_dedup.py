"""Removal of repeated strings against a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from civicspark.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(40) for _ in range(4)]
    docs = [text(rng.randint(0, 200)) for _ in range(n)]
    for i in range(0, n, 3):
        docs[i] += " " + rng.choice(shared) + " " + text(10)
    docs += [docs[0], docs[1], docs[2][:300], "a" * 900, "ab" * 300, "", None, docs[4] + docs[4], "x" * 199, "é" * 150]
    near = docs[5] + text(120)
    for i in range(12):
        at = rng.randrange(len(near))
        docs.append(near[:at] + "Q" + near[at + 1 :])
    return docs


def test_interleave_refinement_finds_equal_windows():
    rng = random.Random(1)
    texts = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 40))) for _ in range(60)})
    got = sd.repeated_windows(texts, np.ones(len(texts), int), 12)
    seen = Counter(t[i : i + 12] for t in texts for i in range(len(t) - 11))
    for t, flags in zip(texts, got, strict=True):
        assert flags.tolist() == [seen[t[i : i + 12]] > 1 for i in range(len(t) - 11)]


@pytest.mark.parametrize("options", [{}, {"hot": 1, "crowd": 2}, {"block_bytes": 4000, "part_bytes": 9000}, {"block_bytes": 4000, "part_bytes": 9000, "hot": 2, "crowd": 3}])
def test_removal_matches_brute_force(spark, options):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, block string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.remove_repeats(df, length=64, gram=16, **options).collect()}
    want = brute(docs, 64)
    assert [got[i] for i in range(len(docs))] == want


def test_parts_of_a_random_text_are_alike():
    data = np.random.default_rng(4).integers(97, 123, 1 << 20).astype(np.uint8)
    _, _, anchor, own = sd.segments(data, np.array([0, len(data)]), 200, 64)
    keys = sd.distinct_pairs(anchor, own, 16)[0]
    for parts in (7, 32):
        sizes = [y - x for x, y in sd.by_part(keys, parts)]
        assert sum(sizes) == len(keys) and max(sizes) < 1.5 * min(sizes)


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(empty).count() == 0
    long = "word " * 60
    df = spark.createDataFrame([(1, long), (1, long), (None, "short"), (None, None)], "doc_id long, text string")
    rows = sorted((r["n_bytes"], r["n_removed"]) for r in sd.remove_repeats(df).collect())
    assert rows == [(0, 0), (5, 0), (300, 300), (300, 300)]
