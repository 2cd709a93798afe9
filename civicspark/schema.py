"""The survey's tables and the constants of its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PER_PAGE, NEWEST, MAX_CODE, MAX_QUERY = 20, 1789, 64, 255
QUESTION_TYPES = ("text", "single_choice", "multi_choice", "scale", "number", "date", "free_text")
CHOICES = ("single_choice", "multi_choice")

#: Columns in the order of the bulk files. "!" marks columns that can't be null.
TABLES = {
    "authors": "id! long, source_author_id string, name string, email_hash string, zipcode string, city string, age_range string, gender string",
    "forms": "id! long, name! string, version string, source string",
    "questions": "id! long, form_id! long, question_code! string, prompt! string, section string, position int, type! string, options_json string",
    "options": "id! long, question_id! long, code! string, label! string, position int, meta_json string",
    "contributions": "id! long, source_contribution_id string, author_id long, form_id! long, source string, theme_id long, submitted_at timestamp_ntz, title string, import_batch_id string, raw_hash string, raw_json string",
    "answers": "id! long, contribution_id! long, question_id! long, position! int, text string, value_json string",
    "answer_options": "answer_id! long, option_id! long",
    "topics": "id! long, slug! string, label! string, parent_id long, depth int, sort_order int, meta_json string",
    "topic_aliases": "id! long, topic_id! long, alias! string",
    "contribution_topics": "contribution_id! long, topic_id! long",
    "search_stats": "query_text! string, search_count int, last_searched timestamp",
    "search_cache": "cache_key! string, results_json! string, search_count int, created_at timestamp",
    "dashboard_cache": "form_id! long, stats_json! string, created_at timestamp, updated_at timestamp",
    "question_stats": "question_id! long, answers_count! long",
    "answer_valid_stats": "id! int, valid_count! long",
}
#: (child, its key, parent, its key), for the checks that a store without foreign keys needs.
REFERENCES = [
    ("questions", "form_id", "forms", "id"), ("options", "question_id", "questions", "id"), ("contributions", "author_id", "authors", "id"), ("contributions", "form_id", "forms", "id"),
    ("answers", "contribution_id", "contributions", "id"), ("answers", "question_id", "questions", "id"), ("answer_options", "answer_id", "answers", "id"), ("answer_options", "option_id", "options", "id"),
]


def struct(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table].replace("! ", " "))


def required(table: str) -> list[str]:
    return [c.split("!")[0].strip() for c in TABLES[table].split(",") if "!" in c]


def schema_diff(df: DataFrame, table: str, ignore: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Columns that are missing, extra or of another type, derived ones aside."""
    want = {f.name: f.dataType.simpleString() for f in struct(table)}
    have = {f.name: f.dataType.simpleString() for f in df.schema if f.name not in ignore}
    return {"missing": sorted(want.keys() - have.keys()), "extra": sorted(have.keys() - want.keys()), "type": sorted(c for c in want.keys() & have.keys() if want[c] != have[c])}


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose key points to nothing; null keys are allowed."""
    return child.where(child[key].isNotNull()).join(parent.select(parent[parent_key].alias("_parent")), child[key] == F.col("_parent"), "left_anti")


