"""Tables that changes are merged into: partitions by a hash of the key, of which only those with a change are written again.

A merge reads the partitions that new rows fall into, finds which rows really differ, and replaces the partitions of these by Spark's dynamic partition
overwrite. What they will hold is written beside the table first: if a merge is broken off while partitions are being replaced, the next one
finishes it before its own. A merge that is run again finds no difference and writes nothing, so files keep their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, remove
from .ingest import Survey

PART = "part_no"
#: What becomes of a column: from the old and the new value, and whether there is an old and a new row.
Rule = Callable[[Column, Column, Column, Column], Column]


def replace(old: Column, new: Column, has_old: Column, has_new: Column) -> Column:
    """The last write wins."""
    return F.when(has_new, new).otherwise(old)


def keep(old: Column, new: Column, has_old: Column, has_new: Column) -> Column:
    """The first write stays."""
    return F.when(has_old, old).otherwise(new)


def fill(old: Column, new: Column, has_old: Column, has_new: Column) -> Column:
    """The new value where there is one."""
    return F.coalesce(new, old)


def add(old: Column, new: Column, has_old: Column, has_new: Column) -> Column:
    """Counters, never below 0."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)))


def _part(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    _finish(spark, path)
    return _rows(spark, path).drop(PART)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The table as it stands, empty as long as no partition was written."""
    schema = spark.read.parquet(f"{path}/empty").schema
    return spark.read.schema(schema).parquet(f"{path}/rows") if exists(spark, f"{path}/rows") else spark.createDataFrame([], schema)


def _finish(spark: SparkSession, path: str) -> None:
    """Replace the partitions that a merge has made ready."""
    if exists(spark, f"{path}/next/_SUCCESS"):
        spark.read.parquet(f"{path}/next").write.partitionBy(PART).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/rows")
    remove(spark, f"{path}/next")


def merge_stored(path: str, new: DataFrame, keys: list[str], rule: Rule | dict[str, Rule] = replace, parts: int = 64) -> int:
    """Merge rows, one a key (`caches.latest_wins` makes them so), into a stored table; how many partitions were written.

    rule: for all columns but the keys, or by column (those that aren't named are replaced). A table that isn't there yet is made. Null keys are
    keys like any other. parts: of a new table; as many as let one be merged in a task's memory many times over.
    """
    spark = new.sparkSession
    _finish(spark, path)
    new = new.select(*(F.col(f"`{c}`").cast("string").alias(c) if kind == "void" else F.col(f"`{c}`") for c, kind in new.dtypes))
    columns = new.columns
    rules = {c: rule.get(c, replace) if isinstance(rule, dict) else rule for c in columns if c not in keys}
    if not exists(spark, f"{path}/empty/_SUCCESS"):
        spark.createDataFrame([(parts,)], "parts int").write.mode("overwrite").parquet(f"{path}/layout")
        new.limit(0).withColumn(PART, F.lit(0)).write.mode("overwrite").parquet(f"{path}/empty")
    old = _rows(spark, path).select(*columns, PART)
    parts = spark.read.parquet(f"{path}/layout").first()["parts"]
    new = new.withColumn(PART, _part(keys, parts)).persist()
    touched = [r[0] for r in new.select(PART).distinct().collect()]  # `parts` numbers at most
    a, b = old.where(F.col(PART).isin(touched)).alias("a"), new.alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    both = a.withColumn("_old", F.lit(True)).alias("a").join(b.withColumn("_new", F.lit(True)).alias("b"), same & (F.col(f"a.{PART}") == F.col(f"b.{PART}")), "full")
    has_old, has_new = F.col("a._old").isNotNull(), F.col("b._new").isNotNull()
    out = {k: F.when(has_old, F.col(f"a.`{k}`")).otherwise(F.col(f"b.`{k}`")) for k in keys}
    out |= {c: r(F.col(f"a.`{c}`"), F.col(f"b.`{c}`"), has_old, has_new).cast(new.schema[c].dataType) for c, r in rules.items()}
    differs = ~has_old
    for c in rules:
        differs = differs | ~out[c].eqNullSafe(F.col(f"a.`{c}`"))
    merged = both.select(*(out[c].alias(c) for c in columns), F.coalesce(F.col(f"a.{PART}"), F.col(f"b.{PART}")).alias(PART), differs.alias("_differs")).persist()
    changed = [r[0] for r in merged.where("_differs").select(PART).distinct().collect()]
    if changed:
        merged.where(F.col(PART).isin(changed)).drop("_differs").repartition(PART).write.mode("overwrite").parquet(f"{path}/next")
        _finish(spark, path)
    merged.unpersist()
    new.unpersist()
    return len(changed)


#: Keys and rules of a survey's tables.
SURVEY: dict[str, tuple[list[str], Rule | dict[str, Rule]]] = {
    "forms": (["id"], keep),
    "questions": (["id"], replace),
    "options": (["id"], {"position": fill}),
    "authors": (["id"], keep),
    "contributions": (["id"], replace),
    "answers": (["id"], replace),
    "answer_options": (["answer_id", "option_id"], keep),
}


def store_survey(survey: Survey, folder: str, parts: int = 64) -> dict[str, int]:
    """Merge an ingested file into the stored survey; the partitions written of each table. Run again, it writes none."""
    out = {}
    for name, (keys, rule) in SURVEY.items():
        rows = getattr(survey, name)
        out[name] = merge_stored(f"{folder}/{name}", rows.dropDuplicates(keys), keys, rule, parts)
    return out
