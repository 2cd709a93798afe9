"""Results as a site serves them: the search page with marks, popularity and cache; an author's page; dashboards with their cache; reports; dry runs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyzers import simple_tokens
from ..functions.highlight import best_fragment
from ..functions.match import Terms, fold, web_query
from ..functions.text import MIN_SEARCH, cache_key, ttl_minutes, valid_text
from ..schema import NEWEST, PER_PAGE
from ..sources.mapping import check_mapping
from ..storage import exists, remove
from . import caches, logs, search, stored
from .index import Index
from .ingest import Survey, ingest
from .paging import offset_page, total_pages

ENTRY = "cache_key string, results_json string, created_at timestamp_ntz"


def served_search(answers: DataFrame, questions: DataFrame, contributions: DataFrame, authors: DataFrame, q: str, searches: DataFrame, index: Index, last: dict | None = None, size: int = PER_PAGE, newest: int = NEWEST, most: int = 18) -> DataFrame:
    """The page of `search_answers` with the marked best part of each text, the query's popularity (searches: query_text, search_count) and the minutes its page may be kept."""
    page = search.search_answers(answers, questions, contributions, authors, q, last, size, newest, index)
    folded = q.strip().lower()
    said = searches.where(F.col("query_text") == folded).agg(F.coalesce(F.max("search_count"), F.lit(0)).alias("popularity"))  # one row
    out = page.withColumn("marked", best_fragment("answer_text", fold(q), most, stemmed=False)).join(F.broadcast(said), F.lit(True))
    return out.withColumn("ttl", ttl_minutes("popularity"))


def through_cache(spark: SparkSession, folder: str, q: str, cursor: str | None, now: Column, compute: Callable[[], DataFrame], popularity: int = 0) -> tuple[DataFrame, bool]:
    """A page from the stored cache where a young enough entry is there, else computed and stored; and whether it was there.

    A page is a bounded number of rows, kept as one JSON text. Every call counts as a search in the stored statistics.
    """
    key = spark.range(1).select(cache_key(F.lit(q), F.lit(cursor or ""))).first()[0]
    if q.strip():
        one = spark.createDataFrame([(q.strip().lower(), 1)], "query_text string, search_count long").withColumn("last_searched", now)
        stored.merge_stored(f"{folder}/stats", one, ["query_text"], {"search_count": stored.add}, parts=16)
    minutes = ttl_minutes(F.lit(popularity))
    df = compute()
    if exists(spark, f"{folder}/cache/empty"):
        hit = caches.lookup(stored.read_stored(spark, f"{folder}/cache"), key, now, minutes).first()
        if hit:
            rows = spark.createDataFrame([(x,) for x in json.loads(hit["results_json"])], "j string")
            return rows.select(F.from_json("j", df.schema).alias("r")).select("r.*"), True
    rows = [r[0] for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]
    entry = spark.createDataFrame([(key, json.dumps(rows))], "cache_key string, results_json string").withColumn("created_at", now)
    stored.merge_stored(f"{folder}/cache", entry.select("cache_key", "results_json", "created_at"), ["cache_key"], parts=16)
    return spark.createDataFrame([(x,) for x in rows], "j string").select(F.from_json("j", df.schema).alias("r")).select("r.*"), False


def clear_cache(spark: SparkSession, folder: str, now: Column | None = None, minutes: int = 60) -> int:
    """Empty the stored cache, or with `now` drop what is older than so many minutes; how many entries went."""
    path = f"{folder}/cache"
    if not exists(spark, f"{path}/empty"):
        return 0
    rows = stored.read_stored(spark, path)
    kept = rows.limit(0) if now is None else caches.expire(rows, now, minutes)
    kept = spark.createDataFrame(kept.collect(), ENTRY)  # a cache is bounded by its life time
    gone = rows.count() - kept.count()
    remove(spark, path)
    stored.merge_stored(path, kept, ["cache_key"], parts=16)
    return gone


def author_page(answers: DataFrame, contributions: DataFrame, author_id, q: str = "", number: int = 1, size: int = PER_PAGE, least: int = MIN_SEARCH) -> DataFrame:
    """A page of an author's answers, newest first, with a search inside, and the numbers of rows and pages. Only the author's texts are analyzed."""
    own = contributions.where(F.col("author_id") == author_id).select(F.col("id").alias("contribution_id"), "submitted_at")
    rows = answers.where(valid_text("text", least)).join(own, "contribution_id")
    if q.strip():
        rows = rows.withColumn("_t", simple_tokens("text")).where(web_query(Terms(F.col("_t")), q)).drop("_t")
    total = rows.agg(F.count("*").alias("total"))
    page = offset_page(rows.select("id", "question_id", "submitted_at", "text"), [("submitted_at", "desc"), ("id", "desc")], number, size)
    return page.join(F.broadcast(total), F.lit(True)).withColumn("pages", total_pages(F.col("total"), size))


def stats_entries(stats: DataFrame, form: str, now: Column) -> DataFrame:
    """A dashboard's statistics as one JSON text a form: cache_key, results_json, created_at. Forms have a bounded number of options."""
    columns = [c for c in stats.columns if c != form]
    rows = stats.groupBy(F.concat(F.lit("dashboard:"), F.col(form).cast("string")).alias("cache_key")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("r"))
    return rows.select("cache_key", F.to_json("r", {"ignoreNullFields": "false"}).alias("results_json"), now.alias("created_at"))


def from_entries(entries: DataFrame, form: str, kind: str, columns: str) -> DataFrame:
    """The statistics that such entries hold; kind: of the form's id; columns: their schema."""
    rows = entries.select(F.substring_index("cache_key", ":", -1).cast(kind).alias(form), F.explode(F.from_json("results_json", f"array<struct<{columns}>>")).alias("r"))
    return rows.select(form, "r.*")


def page_rollup(requests: DataFrame) -> DataFrame:
    """Requests, visitors and errors by path; and by status, in one table: kind, value, requests, visitors, errors."""
    sums = [F.count("*").alias("requests"), F.count_distinct(F.col("ip")).alias("visitors"), F.count_if(F.col("status") >= 400).alias("errors")]
    pages = requests.where(logs.is_page(F.col("method"), F.col("path"), F.col("status"))).groupBy(F.col("path").alias("value")).agg(*sums)
    status = requests.groupBy(F.col("status").cast("string").alias("value")).agg(*sums)
    return pages.select(F.lit("page").alias("kind"), "*").unionByName(status.select(F.lit("status").alias("kind"), "*"))


def dry_run(rows: DataFrame, mapping: dict, warn: int = 50, **options) -> DataFrame:
    """What an ingest would do, without writing: kind, name, value. Findings of the mapping, rows of each table, questions with more than `warn` options from values."""
    spark = rows.sparkSession
    errors, warnings = check_mapping(mapping)
    out = spark.createDataFrame([("error", e, 1) for e in errors] + [("warning", w, 1) for w in warnings], "kind string, name string, value long")
    if errors:
        return out
    s: Survey = ingest(rows, mapping, **options)
    for name in stored.SURVEY:
        out = out.unionByName(getattr(s, name).agg(F.lit("rows").alias("kind"), F.lit(name).alias("name"), F.count("*").alias("value")))
    crowded = s.options.where("position IS NULL").groupBy("question_id").agg(F.count("*").alias("value")).where(F.col("value") > warn)
    named = crowded.join(s.questions.select(F.col("id").alias("question_id"), "question_code"), "question_id")
    return out.unionByName(named.select(F.lit("many options").alias("kind"), F.col("question_code").alias("name"), "value"))


def plan_report(df: DataFrame) -> dict[str, object]:
    """A plan's scans with what they push down and read, its exchanges, joins and Python steps: what to look at before a query goes to a large store."""
    import re

    text = df._jdf.queryExecution().executedPlan().toString()
    scans = [{"filters": re.search(r"PushedFilters: \[([^\]]*)\]", x)[1], "partitions": re.search(r"PartitionFilters: \[([^\]]*)\]", x)[1], "columns": re.search(r"ReadSchema: struct<(.*?)>(?:\n|$|,|\))", x + "\n")[1]} for x in re.findall(r"FileScan[^\n]*", text) if "ReadSchema" in x and "PushedFilters" in x]
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", text)
    return {"scans": scans, "exchanges": len(re.findall(r"(?<!Broadcast)Exchange ", text)), "joins": joins, "python": len(re.findall(r"(?:Arrow|Batch)EvalPython|MapInArrow|MapInPandas|GroupsIn", text)), "all_pairs": any(j in ("BroadcastNestedLoopJoin", "CartesianProduct") for j in joins)}
