"""Choices, ingest, logs, caches and streams on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from civicspark import schema
from civicspark.operators import caches, choices, ingest, logs, rollups
from civicspark.sources import files, mapping
from civicspark.streaming import counters


def test_single_choice_fixture(spark):
    options = spark.createDataFrame([(1, 11, "a", 1), (1, 12, "b", 2), (1, 13, "c", 3), (2, 21, "x", 1)], "question_id long, option_id long, label string, position int")
    picks = spark.createDataFrame([(100, 11), (101, 12)], "answer_id long, option_id long")
    got = {r["option_id"]: (r["count"], r["percentage"]) for r in choices.single_choice_stats(options, picks).collect()}
    assert got == {11: (1, 50.0), 12: (1, 50.0), 13: (0, 0.0), 21: (0, 0.0)}


def test_multi_choice_counts_repeats_and_responses(spark):
    answers = spark.createDataFrame([(1, "a | b|a"), (1, "b|"), (1, "b"), (2, None)], "question_id int, text string")
    got = {r["label"]: (r["count"], r["responses"], r["percentage"]) for r in choices.multi_choice_stats(answers).collect()}
    assert got == {"a": (2, 2, 100.0), "b": (2, 2, 100.0)}


MAPPING = {
    "form": {"name": "F", "version": "1", "source": "t"},
    "defaults": {"author": {"source_author_id": "authorId", "zipcode": "authorZipCode"}, "contribution": {"source_contribution_id": "reference", "submitted_at": "publishedAt", "title": "title"}},
    "questions": [
        {"code": "q1", "type": "single_choice", "source_column": "one", "options": [{"code": "y", "label": "Oui"}], "options_from_values": True},
        {"code": "q2", "type": "multi_choice", "source_column": "many", "options_from_values": True},
        {"code": "q3", "type": "multi_choice", "options": [{"code": "a", "label": "A", "source_column": "ba"}, {"code": "b", "label": "B", "source_column": "bb"}]},
        {"code": "q4", "type": "free_text", "source": {"columns": ["t1", "t2"], "joiner": " / "}},
        {"code": "q5", "type": "number", "source_column": "num"},
    ],
}
CSV = """reference,authorId,authorZipCode,publishedAt,title,trashed,trashedStatus,one,many,ba,bb,t1,t2,num
r1,u1,75001,2019-01-22 09:37:11,T1,,,Oui,a; b;;a,oui,0,x,,3
r1,u1,75001,2019-01-22 09:37:11,T1,,,Oui,a; b;;a,oui,0,x,,3
r2,u1,75001,KO,T2,false,kept,Peut-être,,checked,2,x,y,
r3,u2,,,T3,true,,Non,,,,,,
r4,u3,,,T4,,deleted,Non,,,,,,
"""


def test_ingest_every_branch(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("﻿" + CSV, encoding="utf-8")
    rows = files.read_survey(spark, str(path))
    got = ingest.ingest(rows, MAPPING)
    assert got.forms.count() == 1 and got.questions.count() == 5
    assert got.contributions.count() == 2 and got.authors.count() == 1
    assert {r["submitted_at"] for r in got.contributions.collect()} == {datetime.datetime(2019, 1, 22, 9, 37, 11), None}
    codes = {(r["question_code"], r["code"], r["label"]) for r in got.options.join(got.questions.select(F.col("id").alias("question_id"), "question_code"), "question_id").collect()}
    assert codes == {("q1", "y", "Oui"), ("q1", "peut-tre", "Peut-être"), ("q2", "a", "a"), ("q2", "b", "b"), ("q3", "a", "A"), ("q3", "b", "B")}
    texts = {(r["question_code"], r["text"], r["value_json"]) for r in got.answers.join(got.questions.select(F.col("id").alias("question_id"), "question_code"), "question_id").collect()}
    assert ("q4", "x", None) in texts and ("q4", "x / y", None) in texts and ("q5", None, '{"value":"3"}') in texts
    assert got.answer_options.count() == got.answer_options.distinct().count() == 7
    for child, key, parent, parent_key in [(got.answers, "contribution_id", got.contributions, "id"), (got.answer_options, "option_id", got.options, "id"), (got.contributions, "author_id", got.authors, "id")]:
        assert schema.orphans(child, key, parent, parent_key).count() == 0


def test_empty_file(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV.splitlines()[0] + "\n", encoding="utf-8")
    got = ingest.ingest(files.read_survey(spark, str(path)), MAPPING)
    assert got.answers.count() == got.contributions.count() == 0 and got.questions.count() == 5


def test_zip_gz_and_sniffing(spark, tmp_path):
    import gzip
    import zipfile

    body = "a;b\n1;x,y\n2;\n"
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("note.txt", "no")
        z.writestr("data.csv", body)
    (tmp_path / "f.csv.gz").write_bytes(gzip.compress(body.encode()))
    want = [("1", "x,y"), ("2", "")]
    assert sorted(map(tuple, files.read_survey(spark, str(tmp_path / "f.zip")).collect())) == want
    assert sorted(map(tuple, files.read_survey(spark, str(tmp_path / "f.csv.gz")).collect())) == want
    assert [files.sniff_delimiter(x) for x in ("a,b;c", "a\tb\tc,d", "")] == [",", "\t", ","]


def test_mapping_rules():
    bad = lambda q: mapping.check_mapping({"form": {"name": "x"}, "questions": [{"code": "q", **q}]})
    assert all(bad(q)[0] for q in ({"type": "single_choice"}, {"type": "multi_choice"}, {"type": "free_text"}, {"type": "text"}, {"type": "number"}, {"type": "other"}))
    assert bad({"type": "single_choice", "source_column": "c", "options_from_values": True, "options": [{"label": "a"}]}) == ([], ["q: options and options_from_values together"])
    assert mapping.check_mapping(MAPPING)[0] == []


def test_logs(spark):
    line = '2025-09-01 10:{:02d}:00.1 +0000 UTC [web-1] 1.2.3.{}:80 - "{}" {}'
    lines = [line.format(1, 1, "GET / HTTP/1.1", 200), line.format(2, 2, "GET /static/a.css HTTP/1.1", 200), line.format(3, 2, "GET /x.php HTTP/1.1", 404), line.format(4, 3, "GET /search/answers HTTP/1.1", 408), "", "noise"]
    rows = logs.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows.count() == 4
    assert logs.visitor_report(rows, ["1.2.3.3"]).first().asDict() == {"requests": 4, "visitors": 3, "page_views": 1, "bot_requests": 1, "human_requests": 3}
    bad = rows.where("status >= 400")
    assert {(r["c"], r["count"], r["percentage"]) for r in logs.shares(bad, logs.error_category(F.col("status"), F.col("request")), "c").collect()} == {("Tentatives d'intrusion", 1, 50.0), ("Timeouts de recherche", 1, 50.0)}


def test_caches(spark):
    events = spark.createDataFrame([(" Vélo", 1), ("vélo ", 2), ("  ", 3), (None, 4)], "query string, ts int")
    assert [tuple(r) for r in caches.popularity(events).collect()] == [("vélo", 2, 2)]
    now = F.lit(datetime.datetime(2025, 1, 1, 12))
    cache = spark.createDataFrame([("a", "{}", 1, datetime.datetime(2025, 1, 1, 11, 50)), ("b", "{bad", 1, datetime.datetime(2025, 1, 1, 11, 55))], schema.struct("search_cache"))
    assert caches.lookup(cache, "a", now, 15).count() == 1 and caches.lookup(cache, "a", now, 0).count() == 0 and caches.lookup(cache, "b", now, 15).count() == 0
    assert caches.expire(cache, now, 7).count() == 1
    assert caches.put(cache, cache.where("cache_key = 'a'")).count() == 2


def test_kth_is_held_within_the_group(spark):
    df = spark.createDataFrame([("f", i) for i in range(2)], "form string, id int")
    assert [rollups.kth(df, "form", [F.col("id")], k).first()["id"] for k in (-1, 0, 1, 2, 999)] == [0, 0, 0, 1, 1]


def test_stream_counts(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part in ([(1,), (1,)], [(2,), (1,)]):
        spark.createDataFrame(part, "question_id long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("question_id long").option("maxFilesPerTrigger", 1).parquet(src)
    counters.keep_question_counts(stream, out, str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in counters.read_question_counts(spark, out, 1).collect()} == {(1, 3), (2, 1)}


def test_plans(spark):
    a, b = spark.range(5).withColumn("text", F.lit("x")), spark.range(5)
    plan = rollups.counts_over(b, "id", a, "id", "n")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        ingest.ingest(a, {"form": {}, "questions": []})
