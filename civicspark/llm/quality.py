"""Quality rules whose cutoffs keep false rejection under control.

Four measures of each whole text (symbols, repeated lines, repeated three-word windows, word length) are held
against cutoffs that a labelled holdout selects. Per stratum (language) one sequence lowers the cutoffs of all
measures, a bin of one measure at a time, from the most lenient on. A step is safe if the exact binomial
(Clopper-Pearson) upper bound of the share of good holdout rows that any measure rejects by then is at most `alpha`;
the first unsafe step ends the sequence, so trying many costs nothing (fixed-sequence testing). The order of the steps
comes from the junk rows and from the other strata's good rows, never from the good rows that are tested. The level
is split evenly over strata (Bonferroni), so with probability 1 - `delta` no stratum loses more than `alpha` of its
good rows by these rules. Where no step is safe nothing is rejected: with one stratum that is so under 299 good
holdout rows at the defaults, with four under 437.

Scale: one pass over the texts; the order comes from counts per stratum, measure and bin of the labelled rows, cutoffs
from counts per stratum and step.

Defined results: a null or empty text has no words and fails the base rule. A null stratum is a stratum.
Repeated rows get a row each; an id with labels of both kinds is good. An id without a label is not in the
holdout. No labels: the base rule alone decides. Only id, text and stratum are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, Tables, pieces, span_hashes, table, text_arrays, window_hashes, word_spans

#: Measures as SQL over the counts; larger is worse. Bins are of equal width over [0, 1]; the last holds what is beyond.
MEASURES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "lines": "n_dup_lines / greatest(n_words, 1) * 4",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "length": "abs(word_chars / greatest(n_words, 1) - 5) / 20",
}
BINS = 256
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each key whether it occurs twice or more within its owner; owners ascend."""
    with np.errstate(over="ignore"):
        own = keys ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    s = own[order]
    same = np.zeros(len(s), bool)
    eq = s[1:] == s[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    out = np.empty(len(s), bool)
    out[order] = same
    return out


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The counts of COUNTS for each row, one column each."""
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)
    if not len(data):
        return out
    starts, ends, doc = word_spans(data, offsets)
    out[:, 0] = np.bincount(doc, minlength=n)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offsets[1:]] - total[offsets[:-1]]

    out[:, 1] = per_row(~IS_SPACE[data] & ((data & 0xC0) != 0x80))
    out[:, 2] = per_row(_SYMBOL[data])
    # lines with a word: from one break (newline or row edge) to the next
    breaks = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate((breaks + 1, offsets[:-1])))
    first = first[first < len(data)]
    last = np.concatenate((first[1:], [len(data)]))
    last = np.where(data[last - 1] == 10, last - 1, last)
    words = np.searchsorted(starts, last) - np.searchsorted(starts, first)
    first, last = first[words > 0], last[words > 0]
    owner = np.searchsorted(offsets, first, "right") - 1
    lines = span_hashes(data, first, last)
    order = np.lexsort((first, lines, owner))
    again = (lines[order][1:] == lines[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out[:, 3] = np.bincount(owner[order][1:][again], minlength=n)
    if len(starts) >= 3:
        windows = window_hashes(span_hashes(data, starts, ends), 3)
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        twice = at[repeated(windows[at], doc[at])]
        marked = np.zeros(len(starts), bool)
        for j in range(3):
            marked[twice + j] = True
        out[:, 4] = np.bincount(doc[marked], minlength=n)
    return out


def measure_batches(batches):
    """Arrow: text in the last column becomes the five counts."""
    for batch in batches:
        data, offsets = text_arrays(batch.column(batch.num_columns - 1))
        parts = [text_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in pieces(offsets)]
        counts = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
        names = [*batch.schema.names[:-1], *COUNTS]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(counts[:, i]) for i in range(5))], names)


def binomial_upper(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a share at level 1 - delta, given k of n."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log_choose = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if np.exp(log_choose + i * math.log(p) + (n - i) * math.log1p(-p)).sum() > delta:
            lo = p
        else:
            hi = p
    return hi


def safe_cutoff(bins: np.ndarray, counts: np.ndarray, alpha: float, delta: float, top: int = BINS) -> int | None:
    """The smallest bin b such that rejecting what lies beyond b is safe, trying from the last of `top` bins down."""
    n, beyond, best = int(counts.sum()), 0, None
    held = dict(zip(bins.tolist(), counts.tolist(), strict=True))
    for b in range(top - 1, -1, -1):  # reject bins > b - 1, that is from b on
        beyond += held.get(b, 0)
        if n == 0 or binomial_upper(beyond, n, delta) > alpha:
            break
        best = b
    return best


def step_order(junk: np.ndarray, good: np.ndarray) -> np.ndarray:
    """For each measure and bin, the step that rejects it first; bin 0 is never rejected.

    junk, good: counts by measure and bin, of rows that are not tested. The cutoff goes next to where most junk is gained
    for each good row lost and for each range of bins given up; what then is left goes by the bin, largest first.
    """
    cuts, out, step = [BINS] * len(junk), np.full(junk.shape, len(junk) * BINS, np.int64), 0
    tails = [np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (junk, good)]
    while True:
        best = (0.0, 0, 0)
        for m, cut in enumerate(cuts):
            at = np.arange(1, cut)
            gained, lost = (x[m, 1:cut] - (x[m, cut] if cut < BINS else 0) for x in tails)
            worth = gained / (lost + (cut - at) / BINS)
            if len(at) and worth.max() > best[0]:
                best = (float(worth.max()), m, int(at[worth.argmax()]))
        if not best[0]:
            break
        _, m, to = best
        for b in range(cuts[m] - 1, to - 1, -1):
            out[m, b], step = step, step + 1
        cuts[m] = to
    for b in range(BINS - 1, 0, -1):
        for m, cut in enumerate(cuts):
            if b < cut:
                out[m, b], step = step, step + 1
    return out


def select_cutoffs(holdout: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Per stratum and measure: the bin from which rows are rejected. holdout: stratum, whether a row is good, and its counts."""
    import pandas as pd

    names, steps = list(MEASURES), len(MEASURES) * BINS
    binned = holdout.select("stratum", "good", *(F.expr(f"CAST(least({BINS - 1}, floor(({sql}) * {BINS})) AS INT)").alias(k) for k, sql in MEASURES.items()))
    each = binned.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col(k).alias("bin")) for i, k in enumerate(names)))).alias("x"))
    counts = each.groupBy("stratum", "good", "x.m", "x.bin").count()
    total = np.zeros((2, len(names), BINS))
    for r in counts.groupBy("good", "m", "bin").agg(F.sum("count").alias("n")).collect():  # a few thousand rows at most
        total[int(r["good"]), r["m"], r["bin"]] = r["n"]

    def order(pdf):
        rest = total[1].copy()
        rest[pdf["m"], pdf["bin"]] -= pdf["count"]
        return step_order(total[0], rest)

    def lay(key, pdf):
        return pd.DataFrame({"_stratum": [key[0]], "steps": [order(pdf).ravel().tolist()]})

    good = counts.where("good")
    laid = good.groupBy("stratum").applyInPandas(lay, "_stratum string, steps array<int>")
    first = F.least(*(F.element_at("steps", F.col(k) + (i * BINS + 1)) for i, k in enumerate(names)))
    met = binned.where("good").join(laid, F.col("stratum").eqNullSafe(F.col("_stratum"))).groupBy("stratum", first.alias("step")).count()
    strata = int(good.select("stratum").distinct().count())

    def choose(key, met, own):
        safe = safe_cutoff(steps - 1 - met["step"].to_numpy(), met["count"].to_numpy(), alpha, delta / strata, steps)
        taken = order(own) <= (-1 if safe is None else steps - 1 - safe)
        return pd.DataFrame({"stratum": key[0], "measure": names, "cut": [int(np.append(np.flatnonzero(t), BINS).min()) for t in taken]})

    return met.groupBy("stratum").cogroup(good.withColumnRenamed("stratum", "_stratum").groupBy("_stratum")).applyInPandas(choose, "stratum string, measure string, cut int")


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Per row: id, the counts, base_failed, kept, and the measures beyond their cutoffs.

    alpha: good rows that a stratum may lose at most; delta: the chance that some stratum loses more.
    """
    tables = Tables(docs.sparkSession, "quality")
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).cast("string").alias("text"))
    counted = tables.put(slim.mapInArrow(measure_batches, f"id {kind}, stratum string, " + ", ".join(f"{c} bigint" for c in COUNTS)))
    counted = counted.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    known = labels.where(F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(good_col) == 1).alias("good"))
    cutoffs = select_cutoffs(counted.where("NOT base_failed").join(known, "id"), alpha, delta)
    cutoffs = tables.put(cutoffs.groupBy("stratum").agg(*(F.min(F.when(F.col("measure") == k, F.col("cut"))).alias(f"_{k}") for k in MEASURES)).withColumnRenamed("stratum", "_stratum"))
    judged = counted.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    beyond = F.expr("filter(array(" + ", ".join(f"IF(floor(({sql}) * {BINS}) >= _{k} AND _{k} < {BINS}, '{k}', NULL)" for k, sql in MEASURES.items()) + "), x -> x IS NOT NULL)")
    return judged.select(F.col("id").alias(id_col), *COUNTS, "base_failed", beyond.alias("beyond")).withColumn("kept", ~F.col("base_failed") & (F.size("beyond") == 0))


def op3_quality(spark, sf_dir):
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
