"""Toxicity scores by weak supervision.

Voters are many: fixed word lists, words and word beginnings that a sample's labels point to, and patterns of
form (capitals, exclamation marks, very short texts). A generative label model takes what they say on the sample: by
expectation maximization it estimates each voter's rate of speaking on toxic and on clean rows, with the known labels as one more,
imperfect voter, so a pattern that says more of clean rows speaks for these. The correlations of voters within a class are
estimated along with the rates; a voter's weight is what it adds to those that say the same, the row of the inverse correlation
matrix. A linear classifier is then trained on the posterior labels and scores every whole text; nothing but the text is its input.

Only the sample is bounded: at most `sample_rows` labelled rows outside the holdout, chosen by hash. Words of the
sample are counted by Spark; the driver sees the `candidates` best ones and their places in the sample, then fits
at most `features` weights. Scoring is one pass over the texts without a shuffle.

Defined results: a null or empty text has no voters speaking and gets the classifier's base score, under 0.5.
Repeated rows get a row each; a repeated label counts as toxic if any of them is. Without usable labels the fixed
lists decide alone. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, pieces, span_hashes, table, text_arrays, word_spans

#: Insults by language.
LEXICON = {
    "en": ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumb", "garbage", "vermin", "filth", "freak", "bastard", "asshole", "bitch", "retard"],
    "de": ["idiot", "dummkopf", "abschaum", "widerlich", "wertlos", "trottel", "arschloch", "schlampe", "hurensohn", "dreckig", "vollidiot", "missgeburt"],
    "fr": ["idiot", "imbécile", "crétin", "connard", "connasse", "salope", "ordure", "débile", "minable", "abruti", "dégoûtant", "raclure"],
    "es": ["idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "patético", "asqueroso", "cabrón", "gilipollas", "inútil", "despreciable"],
}
PREFIXES = (5, 6, 7)
IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = True
IS_LETTER[128:] = True
FORM = ("shout", "bang", "short")


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    spaced = np.where(IS_LETTER[data], data, np.uint8(32)) if len(data) else data
    return word_spans(spaced, offsets)


def marks(texts: pa.Array):
    """Per piece of rows: feature keys (words and their beginnings), rows of the keys, and the form measures of rows."""
    import pyarrow.compute as pc

    raw, raw_off = text_arrays(texts)
    data, offsets = text_arrays(pc.utf8_lower(pc.fill_null(texts, "")))
    for lo, hi in pieces(offsets):
        own, rel = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, row = letter_runs(own, rel)
        keys, rows = [span_hashes(own, starts, ends)], [row]
        for n in PREFIXES:
            long = ends - starts > n
            keys.append(span_hashes(own, starts[long], starts[long] + n) ^ np.uint64(n))
            rows.append(row[long])
        src, at = raw[raw_off[lo] : raw_off[hi]], raw_off[lo : hi + 1] - raw_off[lo]

        def per_row(flags, at=at):
            total = np.concatenate(([0], np.cumsum(flags)))
            return total[at[1:]] - total[at[:-1]]

        upper, lower = per_row((src >= 65) & (src <= 90)), per_row((src >= 97) & (src <= 122))
        form = np.stack([upper > 0.5 * np.maximum(upper + lower, 20), per_row(src == 33) > 3, np.bincount(row, minlength=hi - lo) < 5], 1)
        yield lo, hi, np.concatenate(keys), np.concatenate(rows), form


def lexicon_keys() -> dict[int, str]:
    words = sorted({w for ws in LEXICON.values() for w in ws})
    data, offsets = text_arrays(pa.array(words))
    starts, ends, row = letter_runs(data, offsets)
    return {int(k): words[r] for k, r in zip(span_hashes(data, starts, ends).view(np.int64), row, strict=True)}


def seen_keys(batches):
    """Distinct feature keys of each sample row."""
    for batch in batches:
        for lo, _, keys, rows, _ in marks(batch.column("text")):
            with np.errstate(over="ignore"):
                _, first = np.unique(keys ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            at = pa.array(rows[first] + lo)
            yield pa.RecordBatch.from_arrays([batch.column("no").take(at), batch.column("toxic").take(at), pa.array(keys[first].view(np.int64))], ["no", "toxic", "key"])


def cover(hits: dict[int, np.ndarray], precision: dict[int, float], n_rows: int, positives: int, most: int) -> list[int]:
    """Keys that each add toxic rows not yet covered three times: copies of a row can't bring in their other words."""
    covered, chosen, left = np.zeros(n_rows, np.int16), [], dict(hits)
    least = max(3.0, 0.002 * positives)
    while left and len(chosen) < most:
        gains = {k: float((covered[rows] < 3).sum()) * precision[k] for k, rows in left.items()}
        best = max(gains, key=lambda k: (gains[k], k))
        if gains[best] < least:
            break
        covered[left.pop(best)] += 1
        chosen.append(best)
        left = {k: v for k, v in left.items() if gains[k] >= least}
    return chosen


def label_model(votes: np.ndarray, labels: np.ndarray, words: int, rounds: int = 50) -> np.ndarray:
    """Posterior of class 1 by EM; votes: rows x voters, 1 for a voter that speaks, 0 for no opinion.

    The labels are one more voter that may err, and so is "no word speaks", told by the first `words` voters. The share of class 1 is the labels'.
    """
    silent = 1 - np.maximum(labels, votes[:, :words].max(1, initial=0))
    spoken = np.concatenate([votes, labels[:, None], silent[:, None]], 1).astype(float)
    post = np.where(labels > 0, 0.95, np.where(silent > 0, 0.02, 0.2))
    prior = np.clip(labels.mean(), 0.001, 0.5)
    for _ in range(rounds):
        on1 = (post @ spoken + 0.5) / (post.sum() + 1)
        on0 = ((1 - post) @ spoken + 0.5) / ((1 - post).sum() + 1)
        # agreement that the class does not explain: correlations within the classes, shrunk by their own error
        rest = spoken - (post[:, None] * on1 + (1 - post)[:, None] * on0)
        scale = np.sqrt((rest**2).mean(0)) + 1e-6
        corr = (rest / scale).T @ (rest / scale) / len(spoken)
        corr = np.maximum(corr - 4 / np.sqrt(len(spoken)), 0)
        np.fill_diagonal(corr, 1 + 1e-3)
        weight = np.clip(np.linalg.solve(corr, np.ones(len(corr))), 0.05, 1)
        score = np.log(prior / (1 - prior)) + spoken @ (np.log(on1 / on0) * weight)
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        done = np.abs(new - post).max() < 1e-4
        post = new
        if done:
            break
    return post


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the base."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def matrix(texts: pa.Array, vocabulary: np.ndarray) -> np.ndarray:
    """Rows of votes: each word of the (sorted) vocabulary, any of them at all, and the forms."""
    out = np.zeros((len(texts), len(vocabulary) + 2 + len(FORM)), np.float32)
    for lo, _, keys, rows, form in marks(texts):
        if len(vocabulary) and len(keys):
            at = np.searchsorted(vocabulary, keys)
            at[at == len(vocabulary)] = 0
            hit = vocabulary[at] == keys
            out[rows[hit] + lo, at[hit]] = 1
        out[lo : lo + len(form), len(vocabulary) + 2 :] = form
    said = out[:, : len(vocabulary)].sum(1)
    out[:, len(vocabulary)] = said >= 1
    out[:, len(vocabulary) + 1] = said >= 2
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, candidates: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary (sorted keys) and weights. labels: only rows that may be learnt from."""
    tables = Tables(docs.sparkSession, "toxicity")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    # at most sample_rows ids: a bounded side
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").dropDuplicates(["id"])
    sample = tables.put(sample.select(F.xxhash64("id").alias("no"), "toxic", "text"))
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    fixed = np.array(sorted(lexicon_keys()), np.int64)
    chosen: list[int] = []
    if pos and neg:
        keys = sample.mapInArrow(seen_keys, "no bigint, toxic int, key bigint")
        stats = keys.groupBy("key").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).where((F.col("p") >= 3) & ((F.col("p") + 0.5) / (F.col("n") + 0.5) >= 40.0 * pos / neg))
        best = stats.orderBy(F.desc("p"), "key").limit(candidates).collect()
        precision = {r["key"]: r["p"] / (r["p"] + r["n"] + 1.0) for r in best}
        if best:
            wanted = docs.sparkSession.createDataFrame([(k,) for k in precision], "key bigint")
            at: dict[int, list[int]] = {}
            for r in keys.where("toxic = 1").join(F.broadcast(wanted), "key").groupBy("key").agg(F.collect_set("no").alias("nos")).collect():  # candidates x toxic sample rows at most
                at[r["key"]] = r["nos"]
            rows = {n: i for i, n in enumerate(sorted({n for ns in at.values() for n in ns}))}
            chosen = cover({k: np.array([rows[n] for n in ns]) for k, ns in at.items()}, precision, len(rows), pos, features)
    vocabulary = np.unique(np.concatenate([fixed, np.array(chosen, np.int64)])).view(np.uint64)
    vocabulary = np.sort(vocabulary)
    width = len(vocabulary) + 2 + len(FORM)

    def votes(batches):
        for b in batches:
            m = matrix(b.column("text"), vocabulary)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([np.flatnonzero(r).astype(np.int32) for r in m], pa.list_(pa.int32()))], ["toxic", "on"])

    spoken = sample.mapInArrow(votes, "toxic int, on array<int>").groupBy("toxic", "on").count().collect()  # sample_rows at most, equal ones together
    x, y = np.zeros((sum(r["count"] for r in spoken), width), np.float32), []
    for r in sorted(spoken, key=lambda r: (r["toxic"], r["on"])):
        for _ in range(r["count"]):
            x[len(y), r["on"]] = 1
            y.append(r["toxic"])
    if not pos or not neg:
        w = np.zeros(width + 1)
        w[len(vocabulary)], w[-1] = 4.0, -3.0
        return vocabulary, w
    own = [*range(len(vocabulary)), *range(len(vocabulary) + 2, width)]  # words and forms; how many words speak is no voter, but a feature
    post = label_model(x[:, own], np.array(y), len(vocabulary))
    return vocabulary, fit_linear(x.astype(float), post)


def held_out(id_column, parts: int = 5):
    """Whether a row's label must not be learnt from."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(parts)) == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, candidates: int = 2_000, features: int = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns in `keep`, held_out, score (0 to 1) and predicted (score >= 0.5).

    sample_rows: the labelled rows that the model learns from at most. candidates, features: see above.
    """
    usable = labels.where(~F.coalesce(held_out(F.col(id_col)), F.lit(True)))
    vocabulary, w = train(docs, usable, id_col, text_col, label_col, sample_rows, candidates, features)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((vocabulary, w))  # features + lexicon numbers

    def scored(batches):
        vocab, weights = model.value
        for b in batches:
            m = matrix(b.column("_text"), vocab)
            p = 1 / (1 + np.exp(-np.clip(m @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p.astype(np.float64))], [*b.schema.names[:-1], "_score"])

    out = docs.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"{n} {t}" for n, t in out.dtypes[:-1]) + ", _score double"
    out = out.mapInArrow(scored, schema)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.coalesce(held_out(F.col("_id")), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with the columns they came with."""
    rest = tuple(c for c in docs.columns if c != id_col)
    return score_toxicity(docs, labels, id_col, text_col, keep=rest).where("predicted = 0").select(*docs.columns)


def op9_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
