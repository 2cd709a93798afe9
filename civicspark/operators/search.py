"""Full-text search over a column of terms: BM25 ranking, keyword counts, and the pages of answers. `index` has the stored form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyzers import simple_tokens
from ..functions.highlight import fragment
from ..functions.match import Terms, expression_query, fold, plain_query, web_query
from ..functions.text import MIN_SEARCH, MIN_TIMELINE, MAX_TEXT_LEN, postprocess_excerpt, slugify, valid_text, with_default
from ..schema import CHOICES, NEWEST, PER_PAGE
from .index import Index, matches
from .paging import page
from .rollups import counts_over


def with_terms(df: DataFrame, text: str = "text", analyzer: Callable = simple_tokens) -> DataFrame:
    """The table with its terms: derive once, write, and search without analyzing again."""
    return df.withColumn("tokens", analyzer(text))


def _times(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == word)).cast("double")


def bm25(df: DataFrame, query: str, tokens: str = "tokens", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows with any of the query's words and their score (Robertson and Zaragoza 2009), higher is better.

    One pass counts rows, mean length and the words' rows; its single row becomes literals of the scoring plan.
    """
    words = list(dict.fromkeys(fold(query)))
    if not words:
        return df.withColumn("score", F.lit(0.0)).where(F.lit(False))
    t = F.col(tokens)
    stats = df.agg(F.count("*").alias("n"), F.avg(F.size(t)).alias("mean"), *(F.count_if(F.array_contains(t, w)).alias(f"d{i}") for i, w in enumerate(words))).first()
    score = F.lit(0.0)
    for i, w in enumerate(words):
        tf = _times(t, w)
        idf = F.log(F.lit(1 + (stats["n"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size(t) / F.lit(float(stats["mean"] or 1))))
    return df.where(F.arrays_overlap(t, F.array(*map(F.lit, words)))).withColumn("score", score)


def keyword_counts(df: DataFrame, keywords: dict[str, str], tokens: str = "tokens") -> DataFrame:
    """Per label: the rows that its expression matches; all labels in one pass."""
    terms = Terms(F.col(tokens))
    names = list(keywords)
    counts = df.agg(*(F.count_if(expression_query(terms, keywords[k])).alias(f"c{i}") for i, k in enumerate(names)))
    pairs = ", ".join(f"'{k.replace(chr(39), chr(92) + chr(39))}', c{i}" for i, k in enumerate(names))
    return counts.selectExpr(f"stack({len(names)}, {pairs}) AS (keyword, count)")


def similarity(a: Column, b: Column) -> Column:
    """Share of common three-letter pieces of two words."""
    def grams(c):
        padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))

    x, y = grams(a), grams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def search_answers(answers: DataFrame, questions: DataFrame, contributions: DataFrame, authors: DataFrame, q: str, last: dict | None = None, size: int = PER_PAGE, newest: int = NEWEST, index: Index | None = None) -> DataFrame:
    """A page of answers: with two characters or more in q the newest matches, else the timeline.

    Matches are cut to the newest before anything is joined; the timeline is filtered first. A search reads the index if
    there is one, else answers need a `tokens` column. With an index the keys of the page (`size` at most) are known
    before the texts are read, so the scan skips all other row groups.
    """
    q = q.strip()
    kinds = questions.select(F.col("id").alias("question_id"), F.col("prompt").alias("question_prompt"), "type")
    keys, own = [("id", "desc")], answers.select("id", "question_id", "contribution_id", "text")
    shown_type = ~F.col("type").isin(*CHOICES)
    if len(q) >= 2 and index is not None:
        long = index.docs.where(F.col("chars") >= MIN_SEARCH).select("key")
        hits = page(matches(index, lambda t: web_query(t, q)).join(long, "key", "left_semi").select(F.col("key").alias("id")), keys, size=newest)
        hits = hits.join(own.select("id", "question_id"), "id").join(kinds, "question_id").where(shown_type)
        ids = [r["id"] for r in page(hits.select("id"), keys, last, size).collect()]
        shown = own.where(F.col("id").isin(*ids) if ids else F.lit(False)).join(kinds, "question_id")
    elif len(q) >= 2:
        hits = answers.where(valid_text("text", MIN_SEARCH) & web_query(Terms(F.col("tokens")), q)).select(*own.columns)
        shown = page(page(hits, keys, size=newest).join(kinds, "question_id").where(shown_type), keys, last, size)
    else:
        shown = page(own.where(valid_text("text", MIN_TIMELINE)).join(kinds, "question_id").where(shown_type), keys, last, size)
    shown = shown.join(contributions.select(F.col("id").alias("contribution_id"), "author_id", "submitted_at"), "contribution_id").join(authors.select(F.col("id").alias("author_id"), F.col("name").alias("author_name")), "author_id", "left")
    return shown.select(
        F.col("id").alias("answer_id"), "question_id", with_default("question_prompt", F.lit("question-"), F.col("question_id").cast("string")).alias("question_prompt"), "author_id", "submitted_at",
        F.when(F.col("author_id").isNotNull(), with_default("author_name", F.lit("Auteur #"), F.col("author_id").cast("string"))).alias("author_name"),
        F.left("text", F.lit(MAX_TEXT_LEN)).alias("answer_text"), postprocess_excerpt("text").alias("excerpt"),
    ).orderBy(F.desc("answer_id"))


def ranked(rows: DataFrame, text: str, q: str, key: str = "id", digits: int = 6) -> DataFrame:
    """Rows that hold all of q's words, with their BM25 score over all rows, rounded so that a cursor can name it.

    For the small tables of forms and questions: terms are derived here. One pass makes the counts, joined back by word.
    """
    words = list(dict.fromkeys(fold(q)))
    if not words:
        return rows.withColumn("score", F.lit(0.0)).where(F.lit(False))
    terms = rows.select(F.col(key).alias("_key"), simple_tokens(text).alias("_t"))
    counted = terms.agg(F.count("*").alias("_n"), F.avg(F.size("_t")).alias("_mean"), *(F.count_if(F.array_contains("_t", w)).alias(f"_d{i}") for i, w in enumerate(words)))
    hits = terms.where(plain_query(Terms(F.col("_t")), q)).withColumn("_one", F.lit(1)).join(F.broadcast(counted.withColumn("_one", F.lit(1))), "_one")  # one row
    score = F.lit(0.0)
    for i, w in enumerate(words):
        tf, d = _times(F.col("_t"), w), F.col(f"_d{i}")
        score = score + F.log(F.lit(1.0) + (F.col("_n") - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.size("_t") / F.col("_mean")))
    return rows.join(hits.select(F.col("_key").alias(key), F.round(score, digits).alias("score")), key)


def search_forms(forms: DataFrame, questions: DataFrame, q: str = "", last: dict | None = None, size: int = PER_PAGE) -> DataFrame:
    """A page of forms with their numbers of questions: the best matches of q, or the newest where q is empty."""
    rows = ranked(forms, "name", q) if q.strip() else forms.withColumn("score", F.lit(0.0))
    shown = page(rows, [("score", "desc"), ("id", "desc")], last, size)
    out = counts_over(shown, "id", questions, "form_id", "questions_count")
    return out.select("id", "name", F.col("questions_count").cast("int").alias("questions_count"), slugify(with_default("name", F.lit("form-"), F.col("id").cast("string"))).alias("slug"), "score").orderBy(F.desc("score"), F.desc("id"))


def search_questions(questions: DataFrame, stats: DataFrame, q: str = "", last: dict | None = None, size: int = PER_PAGE) -> DataFrame:
    """A page of questions with their maintained answer counts (question_id, answers_count) and the marked part of the prompt."""
    rows = ranked(questions, "prompt", q) if q.strip() else questions.withColumn("score", F.lit(0.0))
    shown = page(rows, [("score", "desc"), ("id", "desc")], last, size).join(stats, F.col("id") == F.col("question_id"), "left")
    marked = fragment("prompt", fold(q)) if q.strip() else F.lit(None).cast("string")
    return shown.select("id", "question_code", F.col("prompt").alias("title"), "type", F.coalesce("answers_count", F.lit(0)).cast("int").alias("answers_count"), marked.alias("prompt_hl"), slugify(with_default("prompt", F.lit("question-"), F.col("id").cast("string"))).alias("slug"), "score").orderBy(F.desc("score"), F.desc("id"))
