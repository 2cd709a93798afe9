"""Search popularity, result caches with a life time, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import MAX_QUERY


def popularity(events: DataFrame, query: str = "query", at: str = "ts") -> DataFrame:
    """Per folded query: how often and when last; blank ones don't count."""
    folded = F.left(F.lower(F.trim(F.col(query))), F.lit(MAX_QUERY))
    return events.where(F.coalesce(folded, F.lit("")) != "").groupBy(folded.alias("query_text")).agg(F.count("*").cast("int").alias("search_count"), F.max(at).alias("last_searched"))


def add_popularity(stats: DataFrame, events: DataFrame, query: str = "query", at: str = "ts") -> DataFrame:
    """Old counts and new events together."""
    both = stats.select("query_text", "search_count", "last_searched").unionByName(popularity(events, query, at))
    return both.groupBy("query_text").agg(F.sum("search_count").cast("int").alias("search_count"), F.max("last_searched").alias("last_searched"))


def fresh(created: Column, now: Column, minutes) -> Column:
    return created > now - F.make_dt_interval(mins=minutes if isinstance(minutes, Column) else F.lit(minutes))


def lookup(cache: DataFrame, key: str, now: Column, minutes) -> DataFrame:
    """The entry of a key if it is young enough and its JSON is sound."""
    return cache.where((F.col("cache_key") == key) & fresh(F.col("created_at"), now, minutes) & F.try_parse_json("results_json").isNotNull())


def put(cache: DataFrame, entries: DataFrame, key: str = "cache_key") -> DataFrame:
    """New entries replace old ones with their key."""
    return cache.join(entries.select(key), key, "left_anti").unionByName(entries)


def expire(cache: DataFrame, now: Column, minutes, at: str = "created_at") -> DataFrame:
    """What is still alive."""
    return cache.where(fresh(F.col(at), now, minutes))


def cache_summary(cache: DataFrame, body: str, at: str) -> DataFrame:
    """One row: entries, characters in all and on average, oldest and newest."""
    size = F.char_length(body)
    return cache.agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("total_size"), F.avg(size).alias("mean_size"), F.min(at).alias("oldest"), F.max(at).alias("newest"))


def ages(cache: DataFrame, key: str, body: str, at: str, now: Column) -> DataFrame:
    """Size and age in minutes of each entry."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))
    return cache.select(key, F.char_length(body).cast("long").alias("size"), F.col(at).alias("updated"), (seconds / 60).alias("age_minutes"))


def latest_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last")


def upsert_options(old: DataFrame, new: DataFrame) -> DataFrame:
    """Options by (question, code): the new label, the new position or else the old one. New rows need an `id`."""
    a = old.select("question_id", "code", F.col("id").alias("old_id"), F.col("label").alias("old_label"), F.col("position").alias("old_position"))
    both = a.join(new, ["question_id", "code"], "full")
    return both.select(F.coalesce("old_id", "id").alias("id"), "question_id", "code", F.coalesce("label", "old_label").alias("label"), F.coalesce("position", "old_position").alias("position"))


def merge_counts(counts: DataFrame, changes: DataFrame, key: str, value: str = "answers_count") -> DataFrame:
    """Counters after changes (key, delta), never below 0."""
    both = counts.select(key, F.col(value).alias("_v")).unionByName(changes.select(key, F.col("delta").alias("_v")))
    return both.groupBy(key).agg(F.greatest(F.lit(0), F.sum("_v")).cast("long").alias(value))
