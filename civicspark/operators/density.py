"""Themes by density: a neighbour graph of vectors, its spanning tree by rounds of smallest edges, a cut by stability.

Every step is a table: leaves of random trees meet for neighbours, each component finds its smallest edge by a grouped
minimum, and the hierarchy is held at `levels` distances, whose components are joined upwards (values) and downwards
(choices). Nothing but distances of levels, directions and flags comes to the driver.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import remove, shared_dir
from .themes import words


class Store:
    """Tables of one run, in a folder of their own under the shared one."""

    def __init__(self, spark) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/density-{uuid.uuid4().hex}", 0

    def put(self, rows: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def instead(self, old: str, rows: DataFrame) -> DataFrame:
        """The table in place of an older one, which goes once this one is written."""
        out = self.put(rows)
        remove(self.spark, old)
        return out

    @property
    def last(self) -> str:
        return f"{self.folder}/{self.n}"

    def put_seen(self, rows: DataFrame, fact: Column):
        """The table, and an aggregate of it that is taken while it is written."""
        seen = Observation()
        out = self.put(rows.observe(seen, fact.alias("fact")))
        return out, seen.get["fact"]


class Level(NamedTuple):
    """At one distance: which component each smaller one (`child`, of `size` rows) lies in."""

    distance: float
    tree: DataFrame


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def word_vectors(df: DataFrame, key: str, text: str = "text", width: int = 64) -> DataFrame:
    """key, vector: a text's words counted in `width` places by their hash, at length 1; null where there is no word."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    rows = df.select(F.col(key), words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    counted = Normalizer(inputCol="_counts", outputCol="_unit").transform(HashingTF(inputCol="_words", outputCol="_counts", numFeatures=width).transform(rows))
    return counted.select(key, F.when(F.size("_words") > 0, vector_to_array("_unit", "float32")).alias("vector"))


def _nodes(store: Store, points: DataFrame, width: int, axes: np.ndarray, directions: int, most: int) -> DataFrame:
    """v, tree, node: each vector's node of `most` vectors or fewer in every tree. Nodes are split at the median along random directions."""
    trees, n = axes.shape[1] // directions, points.count()
    shallow = min(directions, max(1, math.ceil(math.log2(max(1, n / most))) + 2))  # levels beyond them split by keys

    def projected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = axes.reshape(width, trees, directions)[:, :, :shallow].reshape(width, -1)
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            p = np.round(flat @ used, 6).astype(np.float32).reshape(-1, shallow)
            where = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, shallow), pa.int32()), pa.array(p.ravel()))
            n = batch.num_rows
            yield pa.record_batch([batch.column("v").take(pa.array(np.repeat(np.arange(n), trees))), pa.array(np.tile(np.arange(trees), n), pa.int32()), where], names=["v", "tree", "p"])

    at = store.put(points.select("v", "x").mapInArrow(projected, f"v {dict(points.dtypes)['v']}, tree int, p array<float>").withColumn("node", F.lit("1")))
    for depth in range(1 << 20 if n > most else 0):
        side = F.get("p", F.lit(0)).cast("double") if depth < shallow else F.xxhash64("v", F.lit(depth)).cast("double")
        middle = at.groupBy("tree", "node").agg(F.count("*").alias("n"), F.percentile_approx(side, 0.5, 1000).alias("mid")).where(F.col("n") > most).drop("n")
        old, middle = store.last, store.put(middle)
        if middle.isEmpty():
            break
        ends = F.col("mid").isNull()
        deeper = F.concat("node", F.when(side > F.col("mid"), "1").otherwise("0"))
        rest = F.slice("p", 2, shallow)  # what is used goes, and all of it in nodes that stay
        at = store.instead(old, at.join(middle, ["tree", "node"], "left").select("v", "tree", F.when(~ends, rest).alias("p"), F.when(ends, F.col("node")).otherwise(deeper).alias("node")))
    return at.drop("p")


def _leaves_of_node(p: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """Places of a node's vectors by leaf: split at the median of each column of p in turn, beyond them by keys, in whose order they are."""
    todo = [(np.arange(len(p)), 0)]
    while todo:
        at, depth = todo.pop()
        if len(at) <= leaf:
            yield at
            continue
        side = p[at, depth] if depth < p.shape[1] else np.arange(len(at))
        half = (len(at) + 1) // 2 - 1
        above = side > np.partition(side, half)[half]
        todo += [(part, depth + 1) for part in (at[above], at[~above]) if len(part)]


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its k nearest others and their squared distances; ties go to the smaller place."""
    n, k = len(x), min(k, len(x) - 1)
    exact = lambda rows, near: ((x[near] - x[rows][:, None]) ** 2).sum(axis=2)
    with np.errstate(all="ignore"):
        square = (x * x).sum(axis=1)
        rough = square[:, None] + square - 2 * (x @ x.T)
        np.fill_diagonal(rough, np.inf)
        some = min(k + 8, n - 1)
        near = np.sort(np.argpartition(rough, some - 1, axis=1)[:, :some], axis=1)
        away = exact(np.arange(n), near)
        order = np.argsort(away, axis=1, kind="stable")[:, :k]
        near, cut = np.take_along_axis(near, order, 1), np.take_along_axis(rough, near, 1).max(axis=1)
        away = np.take_along_axis(away, order, 1)
        sure = ((away[:, -1] + 1e-12 * x.shape[1] * square.max() < cut) | (some == n - 1)) & np.isfinite(4 * square.max())
        for i in np.flatnonzero(~sure):  # others may be as near as the last, as far as rough distances tell
            whole = exact(np.array([i]), np.arange(n)[None])[0]
            whole[i] = np.inf
            near[i] = np.argsort(whole, kind="stable")[:k]
            away[i] = whole[near[i]]
    return near, away


def _near_of_node(k: int, leaf: int, axes: np.ndarray, directions: int):
    """a, near (its k nearest in its leaf: d, b and b's rows n) for each vector of a node."""

    def near_of(key: tuple, node: pa.Table) -> pa.Table:
        tree, depth = key[0].as_py(), len(key[1].as_py()) - 1
        node = node.sort_by("v")
        x = node.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1).astype(np.float64)
        p = np.round(x @ axes[:, tree * directions + min(depth, directions) : (tree + 1) * directions], 6).astype(np.float32)
        a, b, d, count = [], [], [], []
        for at in _leaves_of_node(p, leaf):
            if len(at) > 1:
                near, away = _nearest(x[at], k)
                a.append(at)
                b.append(at[near].ravel())
                d.append(np.sqrt(away).ravel())
                count.append(np.full(len(at), near.shape[1]))
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        keys, b = node.column("v").combine_chunks(), pa.array(cat(b, np.int64))
        ends = np.concatenate([[0], np.cumsum(cat(count, np.int64))])
        found = pa.StructArray.from_arrays([pa.array(cat(d, np.float64)), keys.take(b), node.column("size").combine_chunks().take(b)], names=["d", "b", "n"])
        return pa.table([keys.take(pa.array(cat(a, np.int64))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=["a", "near"])

    return near_of


def neighbours(store: Store, points: DataFrame, width: int, k: int, trees: int, leaf: int, seed: int, most: int | None = None) -> DataFrame:
    """a, b, d, n (b's rows): for each vector (v, x, size) the k nearest that share a leaf with it in some tree; exact where one leaf holds all.

    Nodes of `most` vectors (16 leaves, fewer where vectors are long) are split further by the task that has them.
    """
    directions = max(1, math.ceil(math.log2(max(1, points.count() / leaf))) + 4)
    axes = np.random.default_rng(seed).standard_normal((width, trees * directions))
    most = max(leaf, most or min(16 * leaf, (1 << 20) // width))
    kind = dict(points.dtypes)["v"]
    held = _nodes(store, points, width, axes, directions, most).join(points.select("v", "x", "size"), "v")
    met = held.groupBy("tree", "node").applyInArrow(_near_of_node(k, leaf, axes, directions), f"a {kind}, near array<struct<d double, b {kind}, n bigint>>")
    best = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k)
    return store.put(met.groupBy("a").agg(best.alias("near")).select("a", F.explode("near").alias("e")).select("a", "e.b", "e.d", "e.n"))


def reach_edges(near: DataFrame, sizes: DataFrame, least: int, store: Store | None = None) -> DataFrame:
    """u, x, w: edges of the neighbour graph by mutual reachability.

    A vector's core distance is the one within which `least` rows lie, its own copies included (the farthest
    neighbour's where there are too few); an edge weighs the largest of its length and both core distances.
    """
    of = Window.partitionBy("a")
    held = near.join(sizes.select(F.col("v").alias("a"), F.col("size").alias("n_a")), "a")
    held = held.withColumn("_n", F.col("n_a") + F.sum("n").over(of.orderBy("d", "b").rowsBetween(Window.unboundedPreceding, 0)))
    core = F.when(F.col("n_a") >= least, 0.0).otherwise(F.coalesce(F.min(F.when(F.col("_n") >= least, F.col("d"))).over(of), F.max("d").over(of)))
    cored = held.select("a", "b", "d", core.alias("core_a"))
    cored = store.put(cored) if store else cored
    other = cored.groupBy("a").agg(F.first("core_a").alias("core_b")).withColumnRenamed("a", "b")
    weight = F.greatest("d", "core_a", "core_b")
    return cored.join(other, "b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("x"), weight.alias("w")).groupBy("u", "x").agg(F.min("w").alias("w"))


def _hooked(store: Store, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: the smallest edge of each component, and where each component goes by them (label, to)."""
    ends = active.unionByName(active.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "u", "x"))
    best = store.put(ends.groupBy("a").agg(F.min(F.struct("w", "u", "x", "b")).alias("e")).select("a", "e.b", "e.w", "e.u", "e.x"))
    # edges are in one strict order, so the only circles are two components that choose one another
    back = best.select(F.col("a").alias("b"), F.col("b").alias("_back"))
    to = store.put(best.join(back, "b").select(F.col("a").alias("label"), F.when((F.col("_back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("to")))
    while True:
        twice = to.join(to.select(F.col("label").alias("to"), F.col("to").alias("_far")), "to").select("label", F.col("_far").alias("to"), F.col("to").alias("_mid"))
        further = twice.select(F.col("label").alias("to"), F.col("to").alias("_far"), F.col("_mid").alias("_third"))
        # four steps from each label; where the third does not move on, a chain has ended
        to, moved = store.put_seen(twice.join(further, "to").select("label", F.col("_far").alias("to"), (F.col("_far") != F.col("_third")).alias("moved")), F.count_if("moved"))
        to = to.drop("moved")
        if not moved:
            return best.select("u", "x", "w").distinct(), to


def spanning_levels(store: Store, edges: DataFrame, sizes: DataFrame, distances: list[float]) -> tuple[DataFrame, list[Level]]:
    """The smallest spanning forest (u, x, w) up to the last distance, and the components at each distance where any join.

    A level takes the edges that are longer than the last level's distance, with the components of their ends at that
    level, once; its rounds rewrite only these. Edges within a component go, parallel ones shrink to the smallest.
    """
    smallest = F.min(F.struct("w", "u", "x")).alias("e")

    def moved(rows: DataFrame, to: DataFrame, how: str) -> DataFrame:
        for end in ("a", "b"):
            rows = rows.join(to.select(F.col("label").alias(end), F.col("to").alias("_to")), end, how).withColumn(end, F.coalesce("_to", end)).drop("_to")
        rows = rows.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(smallest)
        return rows.select("a", "b", "e.w", "e.u", "e.x")

    nodes, place, chosen, levels = sizes.select(F.col("v").alias("label"), "size"), None, [], []
    for i, distance in enumerate(distances):
        longer = F.col("w") > distances[i - 1] if i else F.lit(True)
        active = edges.where(longer & (F.col("w") <= distance)).select(F.col("u").alias("a"), F.col("x").alias("b"), "w", "u", "x")
        active, n = store.put_seen(moved(active, place, "left") if place else active, F.count("*"))
        if not n:
            continue
        under = nodes.select(F.col("label").alias("child"), "label", "size")
        while n:
            tree, to = _hooked(store, active)
            chosen.append(tree)
            active, n = store.put_seen(moved(active, to, "inner"), F.count("*"))
            under = under.join(to, "label", "left").select("child", F.coalesce("to", "label").alias("label"), "size")
        under = store.put(under)
        levels.append(Level(distance, under))
        nodes = under.groupBy("label").agg(F.sum("size").alias("size"))
        goes = under.select(F.col("child").alias("to"), F.col("label").alias("_far"))
        place = store.put(place.join(goes, "to").select("label", F.col("_far").alias("to"))) if place else goes.toDF("label", "to")
    forest = edges.limit(0).select("u", "x", "w")
    for tree in chosen:
        forest = forest.unionByName(tree)
    return forest, levels


def stable_cut(store: Store, sizes: DataFrame, levels: list[Level], least: int, single: bool) -> DataFrame:
    """v, cluster: the clusters of `least` rows or more that last longest; other vectors are absent.

    A cluster gains size * (1/distance - 1/next distance) at each level where it goes on; two or more large parts end
    it. It is kept if its own gain is no less than the best of its parts.
    """
    if not levels:
        return sizes.where(F.col("size") >= least).select("v", F.col("v").alias("cluster"))
    inverse = [2 / levels[0].distance, *(1 / level.distance for level in levels), 0.0]
    gain = lambda i: F.col("size") * (inverse[i] - inverse[i + 1])
    large = sizes.where(F.col("size") >= least).select(F.col("v").alias("label"), F.lit(0).cast("long").alias("parts"), gain(0).alias("own"), F.lit(0.0).alias("below"))
    states = [store.put(large)]
    for i, level in enumerate(levels, 1):
        kids = level.tree.join(states[-1].withColumnRenamed("label", "child"), "child", "left")
        held = kids.groupBy("label").agg(F.sum("size").alias("size"), F.count("own").alias("parts"), F.sum("own").alias("o"), F.sum("below").alias("s"), F.sum(F.greatest("own", "below")).alias("best"))
        held = held.where(F.col("size") >= least)
        goes_on = F.col("parts") == 1
        below = F.when(goes_on, F.col("s")).when(F.col("parts") > 1, F.col("best")).otherwise(0.0)
        states.append(store.put(held.select("label", "parts", (gain(i) + F.when(goes_on, F.col("o")).otherwise(0.0)).alias("own"), below.alias("below"))))
    top = states[-1]
    alone = not single and len(top.limit(2).collect()) == 1
    wins = F.lit(False) if alone else F.col("own") >= F.col("below")
    marks = top.select("label", "parts", F.when(wins, F.col("label")).alias("cluster"))
    for level, state in zip(reversed(levels), reversed(states[:-1]), strict=True):
        down = level.tree.join(marks.select("label", F.col("parts").alias("_parts"), "cluster"), "label").select(F.col("child").alias("label"), "_parts", "cluster")
        begins = (F.col("_parts") > 1) & (F.col("own") >= F.col("below"))
        down = down.join(state, "label", "left").withColumn("cluster", F.coalesce("cluster", F.when(begins, F.col("label"))))
        marks = store.put(down.where("parts IS NOT NULL OR cluster IS NOT NULL").select("label", "parts", "cluster"))
    return marks.where("cluster IS NOT NULL").select(F.col("label").alias("v"), "cluster")


def density_themes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: int = 15, k: int = 15, levels: int | list[float] = 12, trees: int = 6, leaf: int = 256, seed: int = 42, single: bool = False) -> DataFrame:
    """key, theme (the smallest key of its cluster; null: noise), theme_rows, for every row.

    least: rows of a theme, and of the neighbourhood whose radius is a core distance. k: neighbours of each vector,
    found among vectors that share a leaf of `leaf` in one of `trees` random trees. levels: the distances of the
    hierarchy, or how many are laid between the smallest and the largest edge, by equal factors. single: whether one theme may hold all.

    Equal vectors are one vector with its number of rows, so copies make no large group. Vectors that are null, empty, hold null or
    non-finite components, or differ in length from most (from the longer ones in a tie) are noise; so are rows without a key's
    cluster of `least` rows. A null key stays; a repeated key has a row for each of its rows. No rows give no rows.
    Parts of the neighbour graph without an edge between them are never in one theme. Reruns agree.
    """
    spark = df.sparkSession
    store = Store(spark)
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    x = F.col("x")
    same = F.when(sound(x), F.unhex(F.sha2(F.concat_ws(",", F.transform(x, lambda c: (c + F.lit(0.0)).cast("string"))), 256).substr(1, 32)))
    given = store.put(df.select(F.col(key).alias("_key"), F.col(vector).cast(kind).alias("x")).select("_key", "x", same.alias("hash")))  # whatever made the vectors runs once
    most = given.where("hash IS NOT NULL").groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = most["n"] if most else 0
    rows = given.select("_key", "x", F.when(F.size("x") == width, F.col("hash")).alias("hash"))
    equal = rows.where("hash IS NOT NULL").groupBy("hash").agg(F.first("x").alias("x"), F.count("*").alias("size"))
    points = store.put(equal.orderBy("hash").withColumn("v", F.monotonically_increasing_id()))  # short keys in the order of the hashes
    sizes = points.select("v", "size")
    clusters = sizes.select("v", F.col("v").alias("cluster")).limit(0)
    if width:
        edges = store.put(reach_edges(neighbours(store, points, width, k, trees, leaf, seed), sizes, least, store))
        low, high = edges.where("w > 0").agg(F.min("w"), F.max("w")).first()
        if low is None:
            distances: Iterable[float] = []
        elif isinstance(levels, int):
            distances = [low * (high / low) ** (i / max(1, levels - 1)) for i in range(levels - 1)] + [math.nextafter(high, math.inf)]
        else:
            distances = sorted(levels)
        _, found = spanning_levels(store, edges, sizes, list(distances))
        clusters = stable_cut(store, sizes, found, least, single)
    placed = store.put(rows.select("_key", "hash").join(points.select("hash", "v").join(clusters, "v").select("hash", "cluster"), "hash", "left"))
    themes = placed.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min("_key").alias("theme"), F.count("*").alias("theme_rows"))
    return placed.join(themes, "cluster", "left").select(F.col("_key").alias(key), "theme", "theme_rows")
