"""The data of single pages: an answer, a question's answers, a form's contribution, dashboards and share images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import MIN_SEARCH, cut, slugify, valid_text, with_default
from .choices import multi_choice_stats, single_choice_stats
from .paging import page
from .rollups import contribution_view, counts_over, kth


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The row of an id, or none; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def answer_page(answers: DataFrame, contributions: DataFrame, questions: DataFrame, authors: DataFrame, answer_id) -> DataFrame:
    """An answer with its question and author: at most one row. The point filter comes first, so the joins are of one row."""
    own = by_id(answers, answer_id).select(F.col("id").alias("answer_id"), "contribution_id", "question_id", F.coalesce("text", F.lit("")).alias("answer_text"))
    own = own.join(contributions.select(F.col("id").alias("contribution_id"), "author_id", "submitted_at"), "contribution_id")
    own = own.join(questions.select(F.col("id").alias("question_id"), F.col("prompt").alias("question_prompt")), "question_id")
    own = own.join(authors.select(F.col("id").alias("author_id"), F.col("name").alias("author_name")), "author_id", "left")
    question = with_default("question_prompt", F.lit("question-"), F.col("question_id").cast("string"))
    author = with_default("author_name", F.lit("Auteur #"), F.coalesce(F.col("author_id").cast("string"), F.lit("None")))
    return own.select("answer_id", "answer_text", "question_id", "question_prompt", slugify(question).alias("question_slug"), "author_id", "author_name", slugify(author).alias("author_slug"), "submitted_at")


def question_answers(answers: DataFrame, contributions: DataFrame, question_id, q: str = "", least: int = MIN_SEARCH) -> DataFrame:
    """A question's valid answers with date and author; q: a part of the text, any case, accents and wildcards as given."""
    own = by_id(answers, question_id, "question_id").where(valid_text("text", least))
    if q.strip():
        own = own.where(F.col("text").ilike(f"%{q.strip()}%"))
    return own.join(contributions.select(F.col("id").alias("contribution_id"), "author_id", "submitted_at"), "contribution_id").select("id", "question_id", "author_id", "submitted_at", "text")


def question_page(answers: DataFrame, contributions: DataFrame, question_id, q: str = "", last: dict | None = None, size: int = 20) -> DataFrame:
    """A page of these, newest first, with the number of all of them."""
    rows = question_answers(answers, contributions, question_id, q)
    total = rows.agg(F.count("*").alias("total")).withColumn("question_id", F.lit(question_id))
    return page(rows, [("submitted_at", "desc"), ("id", "desc")], last, size).join(F.broadcast(total), "question_id")  # one row


def question_totals(answers: DataFrame, q: str = "", least: int = MIN_SEARCH) -> DataFrame:
    """Valid answers of every question, with or without a part of the text."""
    rows = answers.where(valid_text("text", least))
    if q.strip():
        rows = rows.where(F.col("text").ilike(f"%{q.strip()}%"))
    return rows.groupBy("question_id").agg(F.count("*").alias("total"))


def form_page(questions: DataFrame, contributions: DataFrame, answers: DataFrame, form_id, k: int) -> DataFrame:
    """All questions of a form with the answers of its k-th contribution by date."""
    own = by_id(contributions, form_id, "form_id")
    chosen = kth(own, "form_id", [F.col("submitted_at").asc_nulls_last(), F.col("id")], k).select(F.col("id").alias("contribution_id"), "k", "total")
    given = answers.join(F.broadcast(chosen), "contribution_id").select("question_id", "text")  # one row
    return contribution_view(by_id(questions, form_id, "form_id"), given)


def choice_dashboard(questions: DataFrame, options: DataFrame, picks: DataFrame, answers: DataFrame, top: int = 10) -> DataFrame:
    """Statistics of all choice questions: total of what is shown, options in order; questions with nothing to show are left out.

    Single choices: the first options by position, shares of all picks. Multiple ones: the most frequent labels, shares of the responses.
    """
    single = single_choice_stats(options, picks, top=top).join(questions.where("type = 'single_choice'").select(F.col("id").alias("question_id")), "question_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("position").asc_nulls_last(), "option_id"))
    single = single.select("question_id", place.alias("place"), "label", "count", "percentage")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("count"), "label"))
    many = answers.join(questions.where("type = 'multi_choice'").select(F.col("id").alias("question_id")), "question_id", "left_semi")
    many = multi_choice_stats(many, top=top).select("question_id", rank.alias("place"), "label", "count", "percentage")
    rows = single.unionByName(many).groupBy("question_id").agg(F.sum("count").alias("total_answers"), F.array_sort(F.collect_list(F.struct("place", "label", "count", "percentage"))).alias("stats"))  # `top` options a question
    shown = rows.where("total_answers > 0").join(questions.select(F.col("id").alias("question_id"), "form_id", cut("prompt", 80).alias("question_prompt"), "type", "position"), "question_id")
    return shown.select("form_id", "question_id", "question_prompt", "type", "position", "total_answers", F.transform("stats", lambda s: cut(s["label"], 30)).alias("labels"), "stats")


def bar_widths(stats: DataFrame, top: int = 5, most: int = 40) -> DataFrame:
    """The first bars of each question's chart: width in percent of the longest bar of the chart, shortened labels. stats: question_id, place, label, count."""
    longest = F.max("count").over(Window.partitionBy("question_id"))
    width = F.when(longest > 0, F.col("count") / longest * 100).otherwise(F.lit(0.0))
    return stats.withColumn("width_percent", width).where(F.col("place") <= top).select("question_id", "place", cut("label", most).alias("label"), "count", "width_percent")


def legend(stats: DataFrame, shown: int = 4, most: int = 25) -> DataFrame:
    """The first labels of each chart, and how many others there are. stats: question_id, place, label, count."""
    rows = stats.groupBy("question_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", cut("label", most).alias("label"), "count")))).alias("items"))
    return rows.select("question_id", F.transform("items", lambda x: x["label"]).alias("labels"), F.greatest(F.lit(0), F.col("n") - shown).cast("int").alias("others"))


def image_key(*parts: Column) -> Column:
    """Sixteen digits of a hash of what an image shows: the same data, the same file."""
    return F.left(F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), F.lit(16))


def form_images(forms: DataFrame, questions: DataFrame) -> DataFrame:
    """What the share image of each form shows, and its key."""
    out = counts_over(forms.select(F.col("id").alias("form_id"), F.col("name").alias("form_name")), "form_id", questions, "form_id", "questions_count")
    return out.withColumn("image_key", image_key(F.col("form_id"), F.col("form_name"), F.col("questions_count")))


def question_images(questions: DataFrame, options: DataFrame, picks: DataFrame, answers: DataFrame, top: int = 6) -> DataFrame:
    """What the share image of each question shows: its answers' number and, for choices, the first bars; and its key."""
    stats = choice_dashboard(questions.withColumn("form_id", F.lit(0)).withColumn("position", F.lit(0)), options, picks, answers, top)
    bars = stats.select("question_id", F.transform("stats", lambda s: F.concat_ws("=", s["label"], s["count"].cast("string"))).alias("bars"))
    out = counts_over(questions.select(F.col("id").alias("question_id"), F.col("prompt").alias("question_prompt"), F.col("type").alias("question_type")), "question_id", answers, "question_id", "answers_count")
    out = out.join(bars, "question_id", "left")
    return out.withColumn("image_key", image_key(F.col("question_id"), F.col("question_prompt"), F.col("question_type"), F.col("answers_count"), F.array_join("bars", "|")))


def health(tables: DataFrame, live: str = "live", dead: str = "dead") -> DataFrame:
    """One row: live and dead rows of a store's tables, those tables that need care, and the share of dead rows, guarded against nothing."""
    share = F.round(F.sum(dead).cast("decimal(20,0)") * 100 / F.greatest(F.sum(live) + F.sum(dead), F.lit(1)).cast("decimal(20,0)"), 2).cast("double")
    return tables.agg(F.sum(live).cast("long").alias("live"), F.sum(dead).cast("long").alias("dead"), F.sum(F.when(F.col(dead) > F.col(live), 1).otherwise(0)).cast("long").alias("worn"), share.alias("dead_pct"))
