"""Near-duplicate components against brute force, on groups of near copies, and edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from civicspark.llm import near_dup


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = [text(rng.randint(1, 60)) for _ in range(80)]
    for size in (3, 12, 70):
        base = text(80)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(80)] = rng.choice(vocab)
            docs.append(own)
    out = [" ".join(d) for d in docs]
    return out + [out[0].upper(), out[1], out[1], "", None, " \n", "one", "ONE", "one two", "é\u00a0b"]


@pytest.mark.parametrize(("k", "options"), [(2, {}), (5, {}), (2, {"small": 2, "depth": 2, "leader_bands": 1})])
def test_components_match_brute_force(spark, k, options):
    texts = corpus(7)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(df, words=k, **options).collect()}
    for i, (n, root) in enumerate(brute(texts, k, 80)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, root, i == root), texts[i]


def test_nulls_repeats_and_no_rows(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "z"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True), (None, None, True)], key=str)


def test_two_texts_under_one_id_keep_their_links(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "alone and apart from all of them")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_one_row_of_a_component_stays(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "x"), (2, a + " more", "y"), (None, "q r s t u", "z"), (None, "q r s t u", "z"), (5, "", "e"), (5, "", "e"), (6, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = sorted(map(tuple, near_dup.drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, a, "x"), (None, "q r s t u", "z"), (5, "", "e"), (5, "", "e"), (6, None, "n")], key=str)


def test_crowds_of_unlinked_copies_match_brute_force(spark):
    """A large group near the threshold: most pairs aren't linked, some are, and only full comparison tells."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(260):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(4, 12)):
            own[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, words=2, small=6).collect()}
    assert got == {i: root for i, (_, root) in enumerate(brute(texts, 2, 80))}


def test_pairs_of_crowds_are_told_by_bits_of_their_shingles():
    import numpy as np

    from civicspark.llm import near_dup

    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: rng.integers(250, 400)], rng.integers(0, 2**63, 40, dtype=np.uint64)))) for _ in range(30)]
    bits = [np.unique((s >> np.uint64(16)).astype(np.uint32)).tobytes() for s in sets]
    a, b = np.triu_indices(30, 1)
    sizes = np.array([len(s) for s in sets])
    no, yes = near_dup.refuted(sizes[a], sizes[b], [bits[i] for i in a], [bits[i] for i in b], 80)
    common = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert (yes == (common * 100 >= 80 * (sizes[a] + sizes[b] - common))).all() and (no == ~yes).all() and yes.any() and no.any()
    no, yes = near_dup.refuted(sizes[a], sizes[b], [None] * len(a), [bits[i] for i in b], 80)
    assert not no.any() and not yes.any()  # told later, on full sets
    no, _ = near_dup.refuted(np.array([5]), np.array([5]), [np.zeros(1, np.uint32).tobytes()], [np.zeros(1, np.uint32).tobytes()], 80)
    assert not no[0]  # five shingles whose bits are equal refute nothing


def test_too_low_a_threshold_is_an_error_not_a_loss(spark):
    import pytest

    from civicspark.llm import near_dup

    with pytest.raises(ValueError, match="out of reach"):
        near_dup.near_duplicates(spark.createDataFrame([(1, "a b c")], "doc_id int, text string"), percent=5)
