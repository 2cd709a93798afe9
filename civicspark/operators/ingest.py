"""A wide survey file to the normalized tables: one pass over the rows, keys by content, no row-wise lookups.

Ids are hashes of natural keys, so runs agree and new files can be added to old tables. "First" and "last" rows
are those of the file order, which a column of the rows gives; without one the rows' hashes stand for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .caches import latest_wins
from ..functions.text import option_code, parse_datetime, row_hash, truthy
from ..schema import MAX_CODE
from ..sources.mapping import check_mapping, columns_of


@dataclass
class Survey:
    forms: DataFrame
    questions: DataFrame
    options: DataFrame
    authors: DataFrame
    contributions: DataFrame
    answers: DataFrame
    answer_options: DataFrame


def key(*parts: Column) -> Column:
    """A positive 63-bit id of a natural key."""
    return F.shiftrightunsigned(F.xxhash64(*(F.coalesce(p.cast("string"), F.lit("\0")) for p in parts)), 1)


def kept_rows(rows: DataFrame) -> DataFrame:
    """Without rows that were withdrawn."""
    out = rows
    if "trashed" in rows.columns:
        out = out.where(~F.coalesce(F.lower(F.trim("trashed")), F.lit("")).isin("1", "true", "yes", "vrai"))
    if "trashedStatus" in rows.columns:
        status = F.coalesce(F.lower(F.trim("trashedStatus")), F.lit(""))
        out = out.where((status == "") | (status == "kept"))
    return out


def joined(columns: list[str], joiner: str) -> Column:
    """The non-empty ones of some columns."""
    return F.array_join(F.filter(F.array(*(F.trim(F.col(f"`{c}`")) for c in columns)), lambda x: x != ""), joiner)


def merged_texts(rows: DataFrame, keys: list[str], text: str, order: list[Column], joiner: str = "\n\n", most: int = 10_000) -> DataFrame:
    """One text per key: in order, each appended unless what is there already holds it.

    The texts of a key meet in one row: more than `most` are an error, as they are no longer one person's answer.
    """
    rows = rows.groupBy(*keys, F.col(text).alias(text)).agg(*(F.min(o).alias(f"_o{i}") for i, o in enumerate(order)))  # a text again adds nothing
    order = [F.col(f"_o{i}") for i in range(len(order))]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(text).alias("t")))), lambda x: x["t"])
    merged = F.aggregate(ordered, F.lit("").cast("string"), lambda a, x: F.when(a == "", x).when(F.contains(a, x), a).otherwise(F.concat(a, F.lit(joiner), x)))
    held = F.when(F.count("*") > most, F.raise_error(F.lit(f"more than {most} texts of one key"))).otherwise(merged)
    return rows.groupBy(*keys).agg(held.alias(text))


def unpivot(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """key, question, answer, position: a row for each filled cell, numbered in the order of `columns` (question by column)."""
    cells = F.array(*(F.struct(F.lit(q).alias("question"), F.col(f"`{c}`").cast("string").alias("answer")) for c, q in columns.items()))
    filled = F.filter(cells, lambda x: F.coalesce(F.trim(x["answer"]), F.lit("")) != "")
    return rows.select(F.col(key), F.posexplode(filled).alias("_i", "_c")).select(key, "_c.question", "_c.answer", (F.col("_i") + 1).alias("position"))


def ingest(rows: DataFrame, mapping: dict, max_dynamic: int = 500, order: str | None = None, merge: bool = False, keep: str | None = None) -> Survey:
    """rows: text columns of the file. max_dynamic: options that values may add to a question; more is an error.

    order: a column with the rows' order in the files, which is no part of the survey. merge: a contribution that
    occurs in several rows keeps the texts of all, joined in order, where else its last row replaces the others.
    keep: a new folder that driver and executors share; the distinct rows and the last ones of the contributions are written there at once,
    so tables of the survey that are read one by one don't make them again. The caller removes it.
    """
    errors, _ = check_mapping(mapping)
    if errors:
        raise ValueError("; ".join(errors))
    spark, form = rows.sparkSession, mapping["form"]
    defaults = mapping.get("defaults") or {}
    author_of, contribution_of = defaults.get("author") or {}, defaults.get("contribution") or {}
    have = set(rows.columns) - {order}
    field = lambda spec: F.nullif(F.trim(F.col(f"`{spec}`")), F.lit("")) if spec in have else F.lit(None).cast("string")
    original = sorted(have)

    def once(name: str, made: DataFrame) -> DataFrame:
        if keep is None:
            return made
        made.write.parquet(f"{keep}/{name}")
        return spark.read.schema(made.schema).parquet(f"{keep}/{name}")

    rows = kept_rows(rows).withColumn("_hash", row_hash(original)).withColumn("_order", F.col(order) if order else F.col("_hash"))
    # of equal rows the first
    rows = rows.groupBy("_hash").agg(F.min("_order").alias("_order"), *(F.first(F.col(f"`{c}`")).alias(c) for c in original))
    rows = once("rows", rows)
    rows = rows.withColumn("_json", F.to_json(F.struct(*(F.col(f"`{c}`") for c in original))))

    one = spark.range(1)
    form_id = key(F.lit(form.get("name")), F.lit(form.get("version") or ""), F.lit(form.get("source") or ""))
    forms = one.select(form_id.alias("id"), F.lit(form.get("name")).alias("name"), F.lit(form.get("version")).alias("version"), F.lit(form.get("source")).alias("source"))
    asked = [(q["code"], q.get("prompt") or "", q.get("section"), q.get("position"), q["type"]) for q in mapping.get("questions") or []]
    question_id = key(F.lit(form.get("name")), F.lit(form.get("version") or ""), F.lit(form.get("source") or ""), F.col("question_code"))
    questions = spark.createDataFrame(asked, "question_code string, prompt string, section string, position int, type string").select(question_id.alias("id"), form_id.alias("form_id"), "question_code", "prompt", "section", "position", "type")

    # authors: by e-mail hash, else by source id, else one of its own for each row
    has_author = any(v in have for v in author_of.values())
    email, source_id = field(author_of.get("email_hash")), field(author_of.get("source_author_id"))
    author_id = F.when(email.isNotNull(), key(F.lit("e"), email)).when(source_id.isNotNull(), key(F.lit("s"), source_id)).otherwise(key(F.lit("r"), F.col("_hash")))
    rows = rows.withColumn("_author", author_id if has_author else F.lit(None).cast("long"))
    attributes = ["source_author_id", "name", "email_hash", "zipcode", "city", "age_range", "gender"]
    person = F.struct(*(field(author_of.get(a)).alias(a) for a in attributes))
    authors = rows.where("_author IS NOT NULL").groupBy("_author").agg(F.min_by(person, F.struct("_order", "_hash")).alias("p")).select(F.col("_author").alias("id"), "p.*")

    source_contribution = field(contribution_of.get("source_contribution_id"))
    rows = rows.withColumn("_contribution", key(F.lit(form.get("source") or ""), F.coalesce(source_contribution, F.col("_hash"))))
    every = rows
    rows = once("last", latest_wins(rows, ["_contribution"], [F.desc("_order"), F.desc("_hash")]))
    contributions = rows.select(
        F.col("_contribution").alias("id"), source_contribution.alias("source_contribution_id"), F.col("_author").alias("author_id"), form_id.alias("form_id"), F.lit(contribution_of.get("source") or form.get("source")).alias("source"),
        parse_datetime(field(contribution_of.get("submitted_at"))).alias("submitted_at"), field(contribution_of.get("title")).alias("title"), F.col("_hash").alias("raw_hash"), F.col("_json").alias("raw_json"),
    )

    # one struct for each question: text or value, and the labels chosen
    cells, static = [], []
    for q in mapping.get("questions") or []:
        code, kind, options = q["code"], q["type"], q.get("options") or []
        for i, o in enumerate(options):
            static.append((code, str(o.get("code") or ""), str(o.get("label") or ""), o.get("position") or i + 1))
        text, value, labels = F.lit(None).cast("string"), F.lit(None).cast("string"), F.array().cast("array<string>")
        column = F.trim(F.col(f"`{q['source_column']}`")) if q.get("source_column") in have else F.lit("")
        if kind == "free_text":
            text = joined([c for c in columns_of(q) if c in have], (q.get("source") or {}).get("joiner") or "\n\n") if any(c in have for c in columns_of(q)) else F.lit("")
        elif kind == "text":
            text = column
        elif kind in ("number", "scale", "date"):
            value = F.when(column != "", F.to_json(F.struct(column.alias("value"))))
        elif kind == "single_choice":
            labels = F.when(column != "", F.array(column)).otherwise(labels)
            text = column
        else:
            ticked = [F.when(truthy(F.col(f"`{o['source_column']}`")), F.lit(str(o.get("label") or ""))) for o in options if o.get("source_column") in have]
            split = F.transform(F.split(column, "[" + (q.get("delimiter") or ";") + "]"), lambda x: F.trim(x)) if q.get("options_from_values") or not ticked else F.array().cast("array<string>")
            labels = F.array_distinct(F.filter(F.concat(F.array(*ticked).cast("array<string>"), split), lambda x: x.isNotNull() & (x != "")))
        cells.append(F.struct(F.lit(code).alias("question_code"), F.nullif(text, F.lit("")).alias("text"), value.alias("value_json"), labels.alias("labels")))
    unpivoted = lambda r: r.select(F.col("_contribution").alias("contribution_id"), F.col("_order").alias("seq"), F.explode(F.array(*cells)).alias("c")).select("contribution_id", "seq", "c.*").withColumn("question_id", question_id)
    long = unpivoted(rows)
    if merge:
        texts = merged_texts(unpivoted(every).where("text IS NOT NULL"), ["contribution_id", "question_id"], "text", [F.col("seq")])
        long = long.withColumnRenamed("text", "_own").join(texts, ["contribution_id", "question_id"], "left").drop("_own")
    long = long.where("text IS NOT NULL OR value_json IS NOT NULL OR size(labels) > 0").withColumn("id", key(F.col("contribution_id"), F.col("question_id"), F.lit(1)))
    answers = long.select("id", "contribution_id", "question_id", F.lit(1).alias("position"), "text", "value_json")

    # options: the mapping's, then the values that are none of them; labels with one code share an option
    given = spark.createDataFrame(static, "question_code string, code string, label string, position int") if static else spark.createDataFrame([], "question_code string, code string, label string, position int")
    given = given.withColumn("code", F.when(F.col("code") == "", option_code("label", MAX_CODE)).otherwise(F.col("code"))).withColumn("question_id", question_id)
    chosen = long.select(F.col("id").alias("answer_id"), "question_id", "seq", F.explode("labels").alias("label"))
    known = given.groupBy("question_id", "label").agg(F.min("code").alias("known_code"))
    chosen = chosen.join(known, ["question_id", "label"], "left").withColumn("code", F.coalesce("known_code", option_code("label", MAX_CODE)))
    new = chosen.where("known_code IS NULL").groupBy("question_id", "code").agg(F.min_by("label", F.struct("seq", "label")).alias("label")).join(given.select("question_id", "code"), ["question_id", "code"], "left_anti")
    crowd = F.count("*").over(Window.partitionBy("question_id"))
    new = new.withColumn("_n", crowd).withColumn("code", F.when(F.col("_n") > max_dynamic, F.raise_error(F.lit(f"more than {max_dynamic} options from values"))).otherwise(F.col("code"))).drop("_n")
    option_id = key(F.col("question_id"), F.col("code"))
    options = given.select(option_id.alias("id"), "question_id", "code", "label", "position").unionByName(new.select(option_id.alias("id"), "question_id", "code", "label", F.lit(None).cast("int").alias("position")))
    links = chosen.select("answer_id", option_id.alias("option_id")).distinct()
    return Survey(forms, questions, options, authors, contributions, answers, links)
