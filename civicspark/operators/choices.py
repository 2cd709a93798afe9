"""Choice statistics, question-type inference and the fixing of types: one plan for all questions, no loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import not_blank, py_strip


def percent(part: Column, whole: Column) -> Column:
    """Hundredths with two digits, half up; null over nothing."""
    return F.round(part.cast("decimal(20,0)") * 100 / F.nullif(whole.cast("decimal(20,0)"), F.lit(0)), 2).cast("double")


def single_choice_stats(options: DataFrame, picks: DataFrame, question: str = "question_id", option: str = "option_id", label: str = "label", position: str = "position", pick_option: str = "option_id", top: int | None = None, of_top: bool = False) -> DataFrame:
    """Per option: picks (0 if none) and the share of its question's picks.

    top: that many options by position. of_top: the share of the kept options' picks rather than of all.
    """
    counts = picks.groupBy(F.col(pick_option).alias("_picked")).agg(F.count("*").alias("_n"))
    out = options.select(F.col(question).alias("question_id"), F.col(option).alias("option_id"), F.col(label).alias("label"), F.col(position).alias("position")).join(counts, F.col("option_id") == F.col("_picked"), "left")
    out = out.withColumn("count", F.coalesce("_n", F.lit(0)))
    own = Window.partitionBy("question_id")
    kept = out
    if top is not None:
        kept = out.withColumn("_total", F.sum("count").over(own)).withColumn("_rank", F.row_number().over(own.orderBy(F.col("position").asc_nulls_last(), "option_id"))).where(F.col("_rank") <= top)
    total = F.sum("count").over(own) if top is None or of_top else F.col("_total")
    return kept.withColumn("percentage", F.coalesce(percent(F.col("count"), total), F.lit(0.0))).select("question_id", "option_id", "label", "position", "count", "percentage")


def multi_choice_stats(answers: DataFrame, question: str = "question_id", text: str = "text", delimiter: str = "|", top: int | None = None, need_delimiter: bool = True) -> DataFrame:
    """Per chosen label: how often, and its share of the responses (the shares of a question can exceed 100 together).

    Only answers with the delimiter count, unless need_delimiter is off. A label twice in an answer counts twice.
    """
    rows = answers.where(F.contains(F.col(text), F.lit(delimiter))) if need_delimiter else answers.where(not_blank(text))
    labels = F.filter(F.transform(F.split(F.col(text), f"[{delimiter}]"), lambda x: py_strip(x)), lambda x: x != "")
    rows = rows.select(F.col(question).alias("question_id"), labels.alias("labels"))
    responses = rows.groupBy("question_id").agg(F.count("*").alias("responses"))
    counts = rows.select("question_id", F.explode("labels").alias("label")).groupBy("question_id", "label").agg(F.count("*").alias("count"))
    if top is not None:
        rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("count"), "label"))
        counts = counts.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")
    return counts.join(responses, "question_id").select("question_id", "label", "count", "responses", percent(F.col("count"), F.col("responses")).alias("percentage"))


def infer_types(answers: DataFrame, question: str = "question_id", text: str = "text", min_answers: int = 100, min_percentage: float = 30, scale: float = 1.0) -> DataFrame:
    """Per question: answers, those with a pipe, distinct ones, and the type that these suggest, with confidence.

    scale: multiplies the absolute bounds, for corpora of another size.
    """
    out = answers.where(not_blank(text)).groupBy(F.col(question).alias("question_id")).agg(F.count("*").alias("total"), F.count_if(F.contains(F.col(text), F.lit("|"))).alias("pipes"), F.count_distinct(F.col(text)).alias("uniques"))
    out = out.withColumn("pipe_pct", percent(F.col("pipes"), F.col("total"))).withColumn("unique_pct", percent(F.col("uniques"), F.col("total")))
    total, pipes, pct = F.col("total"), F.col("pipes"), F.col("pipes") * 100.0 / F.col("total")
    many = (total >= min_answers) & (pipes >= 1000 * scale)
    multi = F.when(pct >= 40, "high").when((pct >= 20) & (pipes >= 10000 * scale), "medium").when(pct >= min_percentage, "medium")
    some = (pipes >= 500 * scale) & (pct >= 50)
    few = (total >= 10000 * scale) & (F.col("uniques") <= 10) & (F.col("uniques") * 100.0 / total <= 0.1)
    confidence = F.when(many, multi).when(some, "medium").when(few, F.when(F.col("uniques") <= 5, "high").otherwise("medium"))
    kind = F.when(many | some, F.when(confidence.isNotNull(), "multi_choice")).when(few, "single_choice")
    return out.withColumn("suggested", kind).withColumn("confidence", confidence)


def top_answers(answers: DataFrame, question: str = "question_id", text: str = "text", n: int = 15) -> DataFrame:
    """Per question: its n most frequent texts."""
    counts = answers.where(not_blank(text)).groupBy(F.col(question).alias("question_id"), F.col(text).alias("text")).agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("count"), "text"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def unlinked(answers: DataFrame, links: DataFrame) -> DataFrame:
    """Answers without a link. A link to nothing (null) excludes no answer, as an anti-join has it; NOT IN would exclude all."""
    return answers.join(links.select(F.col("answer_id").alias("_linked")), F.col("id") == F.col("_linked"), "left_anti")


def fix_choice(answers: DataFrame, questions: DataFrame, n: int = 15, prefix: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turn questions into single choices: options from their top answers, links of the answers, and the new types.

    An answer goes to the most frequent option whose first characters it starts with. answers: id, question_id,
    text; questions: id.
    """
    own = answers.join(questions.select(F.col("id").alias("question_id")), "question_id", "left_semi")
    best = top_answers(own, n=n)
    options = best.select((F.lit(900000) + F.col("question_id") * 100 + F.col("rank")).cast("long").alias("id"), "question_id", F.concat(F.lit("opt"), F.col("rank")).alias("code"), F.col("text").alias("label"), F.col("rank").alias("position"))
    starts = options.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("id").alias("option_id"), F.left("label", F.lit(prefix)).alias("start")))).alias("starts"))
    first = F.element_at(F.filter("starts", lambda s: F.startswith(F.col("text"), s["start"])), 1)
    links = own.join(starts, "question_id").where(F.exists("starts", lambda s: F.startswith(F.col("text"), s["start"]))).select(F.col("id").alias("answer_id"), first["option_id"].alias("option_id"))
    return options, links, questions.select("id", F.lit("single_choice").alias("type"))
