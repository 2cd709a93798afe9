"""Sentences, keywords in context, word counts, themes and moods of texts."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import shared_dir

#: Words that a task counts at once.
AT_ONCE = 1 << 21
#: Phrases that a snippet must hold.
KEYWORDS = [
    r"\bpass[-\s]?culture\b",
    r"\bjeun(?:e|esse|es)\b",
    r"\bmjc\b",
    r"\béducation populaire\b",
    r"\bétudiant(?:e|s)?\b|\betudiant(?:e|s)?\b",
    r"\blycéen(?:ne|s)?\b|\blyceen(?:ne|s)?\b",
    r"\bcollégien(?:ne|s)?\b|\bcollegien(?:ne|s)?\b",
]


def sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, sent_idx, sentence: split after a full stop, an exclamation or question mark, and white space."""
    parts = F.filter(F.transform(F.split(F.col(text), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(F.col(key), F.posexplode(parts).alias("sent_idx", "sentence"))


def snippets(rows: DataFrame, key: str, patterns: list[str] = KEYWORDS) -> DataFrame:
    """Sentences with a keyword, the one before and the one after ("" at the ends)."""
    w = Window.partitionBy(key).orderBy("sent_idx")
    out = rows.withColumn("prev", F.lag("sentence", 1, "").over(w)).withColumn("next", F.lead("sentence", 1, "").over(w))
    return out.where(F.col("sentence").rlike("(?iuU)" + "|".join(patterns)))


def words(text: str | Column, stops: list[str] = ()) -> Column:
    """Lower-case words of three letters or more: links and other signs are dropped first."""
    c = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(F.lower(c), r"http\S+", " ")
    out = F.regexp_extract_all(plain, F.lit("[a-zàâçéèêëîïôûùüÿñæœ-]{3,}+"), F.lit(0))  # one pass; what is between words is not written anew
    return F.filter(out, lambda w: ~w.isin(list(stops))) if stops else out


def word_counts(df: DataFrame, by: str, text: str = "text", stops: list[str] = ()) -> DataFrame:
    return df.select(F.col(by), F.explode(words(text, stops)).alias("word")).groupBy(by, "word").agg(F.count("*").alias("count"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row by column, missing ones 0."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def lexicon_mood(text: Column, good: list[str], bad: list[str]) -> Column:
    """A mood from two word lists: the default where no classifier is plugged in."""
    w = words(F.left(text, F.lit(512)))
    score = F.size(F.filter(w, lambda x: x.isin(good))) - F.size(F.filter(w, lambda x: x.isin(bad)))
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def _counted(batches):
    """term, rows, occurrences of one- and two-word terms, from rows of words: a row for each term of a batch."""
    for whole in batches:
        sizes = whole.column("_words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        lo = 0
        while lo < whole.num_rows:
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), AT_ONCE, "right")) + lo)
            flat = whole.slice(lo, hi - lo).column("_words").flatten().dictionary_encode()
            row, names = np.repeat(np.arange(hi - lo), sizes[lo:hi]), flat.dictionary
            lo = hi
            code, n = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(names))
            same = row[1:] == row[:-1]
            pairs, pair = np.unique((code[:-1] * n + code[1:])[same], return_inverse=True)
            both = pc.binary_join_element_wise(names.take(pa.array(pairs // n)), names.take(pa.array(pairs % n)), pa.scalar(" ", names.type))
            for terms, at, own in ((names, code, row), (both, pair, row[1:][same])):
                m = max(1, len(terms))
                rows = np.bincount(np.unique(own * m + at) % m, minlength=len(terms))
                yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(rows[: len(terms)], pa.int64()), pa.array(np.bincount(at, minlength=len(terms))[: len(terms)], pa.int64())], ["term", "rows", "occurrences"])


def term_counts(df: DataFrame, key: str, text: str = "text", least: int = 2) -> DataFrame:
    """One- and two-word terms with their rows (by key) and occurrences; those in fewer than `least` rows go.

    Terms are counted where their rows are read, so a term is shuffled once a batch. Only the terms of keys that have several rows meet by key.
    """

    def terms(w):
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(w[i], F.lit(" "), w[i + 1]))
        return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    repeated = rows.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_key").alias("_many"))
    once, more = rows, None
    if not repeated.isEmpty():
        same = F.col("_key").eqNullSafe(F.col("_many"))
        once, more = rows.join(repeated, same, "left_anti"), rows.join(repeated, same, "left_semi")
    counts = once.select(words("_text").alias("_words")).mapInArrow(_counted, "term string, rows long, occurrences long")
    if more is not None:
        made = more.select("_key", F.transform(F.array(words("_text")), terms)[0].alias("_terms"))  # the words are made once
        own = made.select("_key", F.explode("_terms").alias("term")).groupBy("_key", "term").agg(F.count("*").alias("n"))
        counts = counts.unionByName(own.select("term", F.lit(1).cast("long").alias("rows"), F.col("n").alias("occurrences")))
    return counts.groupBy("term").agg(F.sum("rows").alias("rows"), F.sum("occurrences").alias("occurrences")).where(F.col("rows") >= least)


def learnt_mood(df: DataFrame, labelled: DataFrame, label: str, text: str = "text", features: int = 1 << 14) -> DataFrame:
    """Rows with `mood` (the label's 1 as "positive", 0 as "negative") by a linear classifier on hashed words.

    labelled: rows of text and label to learn from. Both sides are Spark ML; nothing is gathered.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    tf = HashingTF(inputCol="_words", outputCol="_features", numFeatures=features, binary=True)
    model = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=0.01, maxIter=30)
    train = labelled.select(words(text).alias("_words"), F.col(label).cast("double").alias("_label")).where("_label IS NOT NULL")
    fitted = model.fit(tf.transform(train))
    out = fitted.transform(tf.transform(df.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))))
    return out.withColumn("mood", F.when(F.col("prediction") == 1, "positive").otherwise("negative")).select(*df.columns, "mood")


def themes(df: DataFrame, text: str = "text", k: int = 6, max_terms: int = 5000, min_df: float = 2, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Rows with their theme: TF-IDF of one- and two-word terms, k-means. Also the terms by index."""
    spark, folder = df.sparkSession, f"{shared_dir(df.sparkSession)}/themes-{uuid.uuid4().hex}"

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # terms are made once, counts once; the passes of the clustering then read weights only
    prepared = put(NGram(n=2, inputCol="_words", outputCol="_pairs").transform(df.withColumn("_words", words(text))).withColumn("_terms", F.concat("_words", "_pairs")).drop("_words", "_pairs"), "terms")
    counted = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=max_terms, minDF=min_df).fit(prepared)
    rows = put(counted.transform(prepared).drop("_terms"), "counts")
    weighted = Pipeline(stages=[IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features")]).fit(rows).transform(rows).drop("_tf", "_idf")
    weighted = put(weighted, "weights")
    model = KMeans(k=k, seed=seed, predictionCol="theme").fit(weighted.select("features").persist())
    return model.transform(weighted), counted.vocabulary


def theme_terms(rows: DataFrame, vocabulary: list[str], n: int = 12) -> DataFrame:
    """Per theme: its n terms of the highest mean weight."""
    sizes = rows.groupBy("theme").agg(F.count("*").alias("rows"))
    terms = rows.sparkSession.createDataFrame(list(enumerate(vocabulary)), "i int, term string")
    held = rows.select("theme", F.unwrap_udt("features").alias("v"))  # type 0 is sparse: its places and values, not the whole vocabulary a row
    pairs = F.when(F.col("v.type") == 0, F.arrays_zip(F.col("v.indices").alias("i"), F.col("v.values").alias("w"))).otherwise(F.transform("v.values", lambda x, i: F.struct(i.alias("i"), x.alias("w"))))
    cells = held.select("theme", F.explode(pairs).alias("c")).select("theme", "c.i", "c.w").where("w > 0").groupBy("theme", "i").agg(F.sum("w").alias("w"))
    means = cells.join(sizes, "theme").withColumn("weight", F.col("w") / F.col("rows")).join(terms, "i")
    rank = F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("weight"), "term"))
    return means.withColumn("rank", rank).where(F.col("rank") <= n).select("theme", "rank", "term", "weight")
