"""Mix sources to target weights, with DataFrame functions alone.

Each source's rows are dealt by hash to blocks of about `block_words` words. A source's target becomes an exact
quota of blocks in a permuted order (whole passes first, then part of one more, down to the rows that come
nearest: texts too long for what is left are passed over). A splitting tree over the output shards halves the quotas of all sources again and again: at each node
the left half's share is a multivariate-hypergeometric draw, made source by source, so shards hold equal numbers
of blocks and every quota is met exactly. A shard takes its share of a source as a run of that source's permuted
blocks, so shards are disjoint, and orders its rows by a local hash.

No source is gathered: sums are per block and source; a source's blocks are ordered within RANGES ranges of their
permuted places, by windows over one range each and one over the ranges' sums; another window runs over the rows of the one
block where a quota ends. Sources themselves are one row each: windows over them, and the tree's nodes, which hold
a number for each, run in one task.

Defined results: a null text has size 0 and takes 0 words. A null source is a source of its own and the last.
Repeated rows count each; they are the same to the mix. A source of no words has target 0. No rows give no rows.
Only the id, text and source columns are read. Draws depend on the seed and the rows only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Tables, table

WEIGHTS = (5.0, 2.0, 1.0)
#: Ranges of a source's permuted blocks, whose sums come before the order within them.
RANGES = 4096
#: Passes over the last block of a quota.
FITS = 6


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per source (one row each: source, source_size): its target. Water-filling in closed form.

    With sources by cap/weight, those that reach their cap come first; what is left is shared by weight.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    first = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    out = sizes.withColumn("_w", w).withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    out = out.withColumn("_total", share * F.sum("source_size").over(every))
    # the level if all before this source are capped and it and all after are not
    out = out.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(first), F.lit(0.0))) / F.sum("_w").over(rest))
    out = out.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"])
    return out.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).cast("double").alias("target"))


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL: how many of `drawn` out of `total` are among `good`, by inversion at uniform u.

    The weights of the distribution follow from one another by their ratios, so two walks over the support do: one
    for their sum, one to the place where u of it is reached. Beyond 12 deviations and 40 places from the mean
    weights are under 1e-30 of the sum, less than a double tells, and are passed over.
    """
    given = f"struct(CAST({total} AS DOUBLE) AS n, CAST({good} AS DOUBLE) AS g, CAST({drawn} AS DOUBLE) AS d, {u} AS u)"
    spread = "sqrt(greatest(0D, t.d * (t.g / greatest(1D, t.n)) * (1 - t.g / greatest(1D, t.n)) * ((t.n - t.d) / greatest(1D, t.n - 1))))"
    reach = f"(12 * {spread} + 40)"
    ends = f"""struct(t.n AS n, t.g AS g, t.d AS d, t.u AS u,
      CAST(greatest(0D, t.d + t.g - t.n, floor(t.d * (t.g / greatest(1D, t.n)) - {reach})) AS BIGINT) AS lo, CAST(least(t.g, t.d, ceil(t.d * (t.g / greatest(1D, t.n)) + {reach})) AS BIGINT) AS hi)"""
    step = "((b.g - i) * (b.d - i) / ((i + 1D) * greatest(1D, b.n - b.g - b.d + i + 1)))"
    whole = f"aggregate(sequence(b.lo, b.hi), struct(1D AS w, 0D AS sum), (f, i) -> struct(f.w * {step} AS w, f.sum + f.w AS sum), f -> f.sum)"
    place = f"aggregate(sequence(b.lo, b.hi), struct(1D AS w, b.u * {whole} AS left, b.lo AS x), (f, i) -> struct(f.w * {step} AS w, f.left - f.w AS left, IF(f.left > 0, i, f.x) AS x), f -> f.x)"
    return f"transform(transform(array({given}), t -> {ends}), b -> {place})[0]"


def shard_ends(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """Per source number: the ends of its shards' runs of permuted blocks, by the splitting tree.

    quotas: source_no, blocks. A node is one row with the quotas of all sources in order.
    """
    tree = quotas.agg(F.expr("array_sort(collect_list(struct(source_no AS s, blocks AS k)))").alias("q")).where(F.size("q") > 0).select(F.lit(0).alias("node"), "q")
    for level in range(levels):
        u = f"((shiftrightunsigned(xxhash64(node, {level}, x.s, {seed}), 12) + 0.5D) / 4503599627370496D)"  # 52 bits
        n = "aggregate(q, 0L, (a, x) -> a + x.k)"
        drawn = hypergeometric("a.total", "x.k", "a.draw", u)
        split = f"""aggregate(q, struct({n} AS total, CAST(({n} + pmod(xxhash64(node, {level}, {seed}), 2)) DIV 2 AS BIGINT) AS draw, CAST(array() AS array<struct<s:int,l:bigint,r:bigint>>) AS got),
          (a, x) -> transform(array({drawn}), l -> struct(a.total - x.k AS total, a.draw - l AS draw, concat(a.got, array(struct(x.s AS s, l AS l, x.k - l AS r))) AS got))[0], a -> a.got)"""
        tree = tree.select("node", F.expr(split).alias("h"))
        tree = tree.select(F.explode(F.expr("array(struct(node * 2 AS node, transform(h, x -> struct(x.s AS s, x.l AS k)) AS q), struct(node * 2 + 1 AS node, transform(h, x -> struct(x.s AS s, x.r AS k)) AS q))")).alias("c")).select("c.node", "c.q")
    leaves = tree.select("node", F.explode("q").alias("x")).select(F.col("x.s").alias("source_no"), "node", F.col("x.k").alias("k"))
    runs = leaves.groupBy("source_no").agg(F.expr("array_sort(collect_list(struct(node, k)))").alias("q"))
    return runs.select("source_no", F.expr("aggregate(q, struct(0L AS at, CAST(array() AS array<bigint>) AS ends), (a, x) -> struct(a.at + x.k AS at, concat(a.ends, array(a.at + x.k)) AS ends), a -> a.ends)").alias("ends"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block_words: int = 1 << 16, levels: int = 3, seed: int = 7) -> DataFrame:
    """Per row: id, size, source_size, target, copies, taken (words), shards (of each copy) and order keys in them.

    share: the mix's words against all words. most: copies of a row, and words of a source against its own, at most.
    2^levels output shards.
    """
    tables = Tables(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    rows = tables.put(rows)
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    sizes = tables.put(
        sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    )
    # One row a source; a null source joins too.
    same = F.col("source").eqNullSafe(F.col("_source"))
    keys = sizes.select(F.col("source").alias("_source"), "source_no", "n_blocks", "source_size", "target")
    rows = rows.join(keys, same).withColumn("block", F.pmod(F.col("h"), F.col("n_blocks"))).drop("_source")
    blocks = rows.groupBy("source_no", "block").agg(F.sum("size").alias("words"))
    # The permuted order, by ranges: sums and counts of the ranges first, then places within each.
    blocks = blocks.withColumn("place", F.xxhash64(F.lit(seed), "source_no", "block")).withColumn("range", F.shiftrightunsigned("place", 52))
    before = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    ranges = blocks.groupBy("source_no", "range").agg(F.sum("words").alias("w"), F.count("*").alias("c"))
    ranges = ranges.select("source_no", "range", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("words_before"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("blocks_before"))
    order = Window.partitionBy("source_no", "range").orderBy("place", "block")
    blocks = blocks.join(ranges, ["source_no", "range"])
    blocks = blocks.withColumn("upto", F.col("words_before") + F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.col("blocks_before") + F.row_number().over(order).cast("long") - 1)
    blocks = blocks.drop("place", "range", "words_before", "blocks_before")
    blocks = blocks.join(sizes.select("source_no", "passes", "rest"), "source_no")
    blocks = blocks.withColumn("whole", F.col("upto") <= F.col("rest")).withColumn("left", F.when(~F.col("whole") & (F.col("upto") - F.col("words") < F.col("rest")), F.col("rest") - F.col("upto") + F.col("words")).otherwise(0.0))
    blocks = tables.put(blocks)
    used = blocks.groupBy("source_no").agg(F.count("*").alias("held"), F.sum((F.col("whole") | (F.col("left") > 0)).cast("long")).alias("part"), F.max("passes").alias("passes"))
    ends = shard_ends(used.select("source_no", (F.col("held") * F.col("passes") + F.col("part")).alias("blocks")), levels, seed)
    used = tables.put(used.select("source_no", "held").join(ends, "source_no"))
    rows = rows.join(blocks.select("source_no", "block", "rank", "whole", "left", "passes"), ["source_no", "block"]).join(used, "source_no")
    # The rows of the blocks where a quota ends, one block a source: in hash order, rows that don't fit are left out and smaller ones
    # go on; what then comes nearer by one more row takes the smallest. A pass takes all that fits up to the first that doesn't.
    own = Window.partitionBy("source_no")
    upto = own.orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.where("left > 0").withColumn("more", F.lit(0))
    for _ in range(FITS):
        cut = cut.withColumn("_left", F.col("left") - F.sum(F.col("more") * F.col("size")).over(own)).withColumn("_fits", (F.col("more") == 0) & (F.col("size") <= F.col("_left")))
        cut = cut.withColumn("more", F.greatest("more", (F.col("_fits") & (F.sum(F.when(F.col("_fits"), F.col("size")).otherwise(0)).over(upto) <= F.col("_left"))).cast("int")))
    last = F.row_number().over(own.orderBy(F.col("more") > 0, F.col("size") == 0, "size", "h"))
    cut = cut.withColumn("_left", F.col("left") - F.sum(F.col("more") * F.col("size")).over(own)).withColumn("_last", last)
    cut = cut.withColumn("more", F.when((F.col("_last") == 1) & (F.col("more") == 0) & (F.col("size") < 2 * F.col("_left")), 1).otherwise(F.col("more"))).drop("_left", "_fits", "_last")
    rows = rows.where("left <= 0").withColumn("more", F.col("whole").cast("int")).unionByName(cut)
    shard = "CAST(size(filter(ends, e -> e <= c * held + rank)) AS INT)"
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("passes") + F.col("more")).alias("copies"),
        ((F.col("passes") + F.col("more")) * F.col("size")).cast("long").alias("taken"),
        F.expr(f"transform(IF(passes + more > 0, sequence(0, passes + more - 1), array()), c -> struct({shard} AS shard, xxhash64({seed}, c, h) AS place))").alias("draws"),
    )


def draw_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: a row for each copy, with its shard and its place in the shard's order."""
    mixed = mix_sources(docs, id_col, **options).where("copies > 0").select(id_col, "draws").groupBy(id_col).agg(F.first("draws").alias("draws"))
    out = docs.join(mixed, id_col).withColumn("_draw", F.explode("draws"))
    return out.select(*docs.columns, F.col("_draw.shard").alias("shard"), F.col("_draw.place").alias("place"))


def op7_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", F.expr("draws.shard").alias("shards"))
