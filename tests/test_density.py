"""Themes by density against a plain version, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicspark.operators import density, themes

LEVELS = [0.15, 0.3, 0.45, 0.7, 1.0, 1.6, 2.5, 4.0]


def blobs(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.2, 25), ((3, 0), 0.3, 20), ((3.0, 2.2), 0.25, 14))]
    parts += [rng.uniform(-3, 7, (12, 2)), np.repeat([[6.0, 6.0]], 7, axis=0)]
    x = np.concatenate(parts)
    return [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(len(x)), x)]


def plain(rows, least, k, levels, single):
    """id -> smallest id of its cluster or None; straight from the definition, by recursion over components."""
    x = sorted({tuple(v) for _, v in rows})
    size = [sum(tuple(v) == p for _, v in rows) for p in x]
    n = len(x)
    d = [[math.dist(p, q) for q in x] for p in x]
    near = [sorted((d[i][j], j) for j in range(n) if j != i)[:k] for i in range(n)]
    core = []
    for i in range(n):
        held, c = size[i], 0.0
        for dist, j in near[i]:
            if held >= least:
                break
            held, c = held + size[j], dist
        core.append(c)
    edges = {(min(i, j), max(i, j)): max(dist, core[i], core[j]) for i in range(n) for dist, j in near[i]}

    def parts_at(most):
        left, out = set(range(n)), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                p = todo.pop()
                seen.add(p)
                for (a, b), w in edges.items():
                    if w <= most and p in (a, b):
                        q = a + b - p
                        if q in left:
                            left.remove(q)
                            todo.append(q)
            out.append(frozenset(seen))
        return out

    all_parts = [parts_at(-1.0)]
    used = []
    for t in sorted(levels):
        parts = parts_at(t)
        if len(parts) < len(all_parts[-1]):
            used.append(t)
            all_parts.append(parts)
    inverse = [2 / used[0], *(1 / t for t in used), 0.0]
    weigh = lambda part: sum(size[p] for p in part)

    def judge(part, i):
        """(gain of the chain that begins here, best of what lies below it, clusters below)"""
        own = weigh(part) * (inverse[i] - inverse[i + 1])
        kids = [q for q in all_parts[i - 1] if q <= part and weigh(q) >= least] if i else []
        if len(kids) == 1:
            o, s, c = judge(kids[0], i - 1)
            return own + o, s, c
        best, chosen = 0.0, []
        for q in kids:
            o, s, c = judge(q, i - 1)
            best += max(o, s)
            chosen += [q] if o >= s else c
        return own, best, chosen

    top = [p for p in all_parts[-1] if weigh(p) >= least]
    chosen = []
    for part in top:
        own, below, under = judge(part, len(used))
        chosen += [part] if own >= below and (single or len(top) > 1) else under
    out = dict.fromkeys((i for i, _ in rows), None)
    for part in chosen:
        inside = [i for i, v in rows if x.index(tuple(v)) in part]
        out |= dict.fromkeys(inside, min(inside))
    return out


@pytest.mark.parametrize(("seed", "k", "single"), [(1, 6, False), (2, 20, False), (3, 20, True)])
def test_density_themes_equal_the_plain_version(spark, seed, k, single):
    rows = blobs(seed)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = density.density_themes(df, "id", "v", least=5, k=k, levels=LEVELS, single=single).collect()
    want = plain(rows, 5, k, LEVELS, single)
    assert {r.id: r.theme for r in out} == want and len(out) == len(rows)
    assert len(set(want.values())) > 2
    counts = {t: sum(v == t for v in want.values()) for t in set(want.values())}
    assert all(r.theme_rows == (counts[r.theme] if r.theme is not None else None) for r in out)


def test_small_leaves_find_the_same_neighbours_and_forest(spark):
    """Leaves far smaller than the table: most true neighbours are met, and the forest is that of a plain Kruskal."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    store = density.Store(spark)
    points = store.put(spark.createDataFrame([(f"{i:03}".encode(), [float(c) for c in v], 1) for i, v in enumerate(x)], "v binary, x array<double>, size long"))
    near = density.neighbours(store, points, 4, 5, 8, 32, 1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    true = {(i, int(j)) for i in range(300) for j in np.argsort(d[i], kind="stable")[:5]}
    met = {(int(r.a), int(r.b)): r.d for r in near.collect()}
    assert len(true & met.keys()) >= 0.9 * len(true)
    assert all(abs(d[i, j] - far) < 1e-12 for (i, j), far in met.items())
    edges = store.put(density.reach_edges(near, points.select("v", "size"), 3))
    listed = sorted((r.w, bytes(r.u), bytes(r.x)) for r in edges.collect())
    forest, levels = density.spanning_levels(store, edges, points.select("v", "size"), [listed[len(listed) // 2][0], listed[-1][0]])
    up = {f"{i:03}".encode(): f"{i:03}".encode() for i in range(300)}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    kept = []
    for w, a, b in listed:
        if root(a) != root(b):
            up[root(a)] = root(b)
            kept.append((a, b, w))
    assert sorted((bytes(r.u), bytes(r.x), r.w) for r in forest.collect()) == sorted((bytes(a), bytes(b), w) for a, b, w in kept)
    assert levels[-1].tree.select("label").distinct().count() == len({root(p) for p in up})


def test_many_copies_nulls_and_odd_vectors(spark):
    """A third of all rows is one vector; nulls, NaN, other lengths and null keys are noise or stay as they are."""
    copies = [(i, [1000.0, 1000.0]) for i in range(400)]
    other = [(1000 + i, [float(i), 0.0]) for i in range(30)]  # a row of points: all core distances but those at its ends are 2
    odd = [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan"), 1.0]), (2004, [float("inf"), 1.0]), (2005, [1.0]), (None, [1000.0, 1000.0]), (7, [1000.0, 1000.0])]
    df = spark.createDataFrame(copies + other + odd, "vec_id long, embedding array<double>").withColumn("theme", F.lit("x")).withColumn("v", F.lit(1)).withColumn("x", F.lit(2))
    out = density.density_themes(df, least=5, k=6, levels=4)
    assert out.columns == ["vec_id", "theme", "theme_rows"]
    rows = out.collect()
    assert len(rows) == 438
    themes = {r.vec_id: (r.theme, r.theme_rows) for r in rows}
    assert all(themes[i] == (0, 402) for i in range(400)) and themes[None] == (0, 402)
    assert all(themes[1000 + i] == (1000, 30) for i in range(30))
    assert all(themes[i] == (None, None) for i in range(2000, 2006))


def test_one_vector_and_no_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert {r.theme for r in density.density_themes(df, least=5).collect()} == {0}
    assert {r.theme for r in density.density_themes(df, least=7).collect()} == {None}
    assert density.density_themes(df.limit(0)).collect() == []
    assert {r.theme for r in density.density_themes(df.withColumn("embedding", F.lit(None).cast("array<double>"))).collect()} == {None}


def test_word_vectors(spark):
    df = spark.createDataFrame([(1, "maison verte maison"), (2, ""), (3, None), (4, "maison maison verte verte maison maison")], "id long, text string")
    got = {r.id: r.vector for r in density.word_vectors(df, "id", width=32).collect()}
    assert got[2] is None and got[3] is None
    assert abs(sum(c * c for c in got[1]) - 1) < 1e-6 and max(abs(a - b) for a, b in zip(got[1], got[4], strict=True)) < 1e-12


def test_levels_rewrite_only_their_own_edges(spark, monkeypatch):
    """Edges of later levels wait in the table: with many levels, what is written stays within a few times the edges."""
    n = 400
    edges = [(i, i + 1, 1.0 + i % 20) for i in range(n - 1)]  # a path whose edges belong to twenty levels
    store = density.Store(spark)
    table = store.put(spark.createDataFrame(edges, "u long, x long, w double"))
    sizes = store.put(spark.range(n).select(F.col("id").alias("v"), F.lit(1).cast("long").alias("size")))
    written, put = [], density.Store.put

    def counted(self, rows):
        out = put(self, rows)
        written.append(out.count() if {"a", "b", "w", "u", "x"} == set(out.columns) else 0)
        return out

    monkeypatch.setattr(density.Store, "put", counted)
    forest, levels = density.spanning_levels(store, table, sizes, [1.0 + i for i in range(0, 20, 4)])
    assert sorted(map(tuple, forest.collect())) == sorted(e for e in edges if e[2] <= 17.0)
    assert len(levels) == 5 and levels[-1].tree.select("label").distinct().count() == n - sum(e[2] <= 17.0 for e in edges)
    assert sum(written) <= 3 * len(edges)


def test_nodes_split_by_a_task_or_by_tables_are_the_same(spark):
    """Neighbours do not depend on where a tree's nodes are split, and equal distances go to the smaller key."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(300, 4)), rng.integers(0, 3, (40, 4)).astype(float)])
    store = density.Store(spark)
    points = store.put(spark.createDataFrame([(i, [float(c) for c in v], 1 + i % 3) for i, v in enumerate(x)], "v long, x array<double>, size long"))
    by_task, by_tables = (sorted(map(tuple, density.neighbours(store, points, 4, 5, 3, 32, 1, most).collect())) for most in (512, 32))
    assert by_task == by_tables and all(n == 1 + b % 3 for _, b, _, n in by_task)


@pytest.mark.parametrize("kind", ["normal", "ties", "copies", "huge"])
def test_nearest_equals_the_plain_order(kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=(90, 6)), "ties": rng.integers(0, 2, (90, 6)).astype(float), "copies": np.ones((40, 3)), "huge": rng.normal(size=(30, 3)) * 1e160}[kind]
    near, away = density._nearest(x, 7)
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(len(x)):
            far = ((x - x[i]) ** 2).sum(axis=1)
            far[i] = np.inf
            want = np.argsort(far, kind="stable")[:7]
            assert near[i].tolist() == want.tolist() and away[i].tolist() == far[want].tolist()


def test_words_in_one_pass(spark):
    """The words of the former form, which wrote each text anew three times."""
    texts = ["Maison-verte à l'œuvre http://x.fr/abc?d fin", "  aa bbb\tcccc\n--- d eee\u0085fff ÉTÉ https", "", None, "http", "été1234abc—ça va ÇA Straße ñandú"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    plain = F.regexp_replace(F.regexp_replace(F.lower("text"), r"http\S+", " "), r"[^a-zàâçéèêëîïôûùüÿñæœ\s-]", " ")
    former = F.filter(F.split(F.trim(F.regexp_replace(plain, r"\s+", " ")), " "), lambda w: F.char_length(w) > 2)
    rows = df.select(themes.words("text").alias("new"), former.alias("old"), themes.words("text", ["fin"]).alias("some")).collect()
    assert [r.new for r in rows] == [r.old for r in rows] and rows[0].some == ["maison-verte", "œuvre"] and rows[3].new is None
    assert themes.words("text")._jc.toString().count("regexp_replace") == 1
