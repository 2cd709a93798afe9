"""Counts and dates per form, question, author; the data of pages and site map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import MIN_SEARCH, slugify, valid_text, with_default

LAST = 999_999


def counts_over(parents: DataFrame, key: str, children: DataFrame, child_key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 if none. Children are counted before the join."""
    counts = children.groupBy(F.col(child_key).alias("_key")).agg(F.count("*").alias("_n"))
    return parents.join(counts, parents[key] == F.col("_key"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_key", "_n")


def valid_answer_count(answers: DataFrame, text: str = "text", least: int = MIN_SEARCH) -> DataFrame:
    return answers.where(valid_text(text, least)).agg(F.count("*").alias("valid_count"))


def kth(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The k-th row of each group in an order, k held within 1 and the group's size.

    Groups are counted first, with a partial aggregation; row numbers stop at k, so a task drops all but k rows of a group before they are sent.
    """
    totals = df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("total"))
    ranked = df.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("k") <= max(1, k))
    return ranked.join(totals, F.col(group).eqNullSafe(F.col("_group"))).where(F.col("k") == F.greatest(F.lit(1), F.least(F.lit(k), "total"))).drop("_group")


def lastmod(entities: DataFrame, key: str, name: str, facts: DataFrame, fact_key: str, at: str, n: int) -> DataFrame:
    """The n entities that changed last: id, name, lastmod."""
    latest = facts.groupBy(F.col(fact_key).alias("_key")).agg(F.max(at).alias("lastmod"))
    return entities.join(latest, entities[key] == F.col("_key")).select(F.col(key).alias("id"), F.col(name).alias("name"), "lastmod").orderBy(F.col("lastmod").desc_nulls_last(), F.desc("id")).limit(n)


def site_map(base: str, fixed: list[str], sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """loc and lastmod of fixed paths and of sections (path, rows of id, name, lastmod)."""
    spark = sections[0][1].sparkSession
    out = spark.createDataFrame([(base + p, None) for p in fixed], "loc string, lastmod string")
    for path, rows in sections:
        loc = F.concat(F.lit(f"{base}{path}/"), F.col("id").cast("string"), F.lit("-"), slugify(with_default("name", F.lit(f"{path.strip('/')}-"), F.col("id").cast("string"))))
        out = out.unionByName(rows.select(loc.alias("loc"), F.date_format("lastmod", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastmod")))
    return out


def contribution_view(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """All questions of a form with the answer of one contribution or null, by position."""
    return questions.join(answers.select("question_id", "text"), questions["id"] == answers["question_id"], "left").select(questions["*"], "text").orderBy(F.coalesce("position", F.lit(LAST)), "id")


def load_report(tables: dict[str, DataFrame], dated: tuple[str, str] | None = None) -> DataFrame:
    """Rows of each table; of one with dates also the first and the last."""
    out = None
    for name, df in tables.items():
        span = (F.min(dated[1]), F.max(dated[1])) if dated and dated[0] == name else (F.lit(None), F.lit(None))
        one = df.agg(F.count("*").alias("rows"), *(c.cast("timestamp_ntz").alias(n) for c, n in zip(span, ("first", "last"), strict=True))).select(F.lit(name).alias("name"), "rows", "first", "last")
        out = one if out is None else out.unionByName(one)
    return out
