"""Caches, dry runs, roll-ups, plans and pages as they are served."""

from pyspark.sql import functions as F

from civicspark.operators import served, stored

AT = "timestamp'2031-01-01 00:00:00'"


def test_pages_go_through_the_stored_cache(spark, tmp_path):
    folder, calls = str(tmp_path / "c"), []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1, "é", None), (2, None, 2.5)], "id long, t string, x double")

    now = lambda minutes: F.expr(f"{AT} + INTERVAL {minutes} MINUTES").cast("timestamp_ntz")
    first, hit = served.through_cache(spark, folder, " Mer", None, now(0), compute)
    assert not hit and {tuple(r) for r in first.collect()} == {(1, "é", None), (2, None, 2.5)}
    again, hit = served.through_cache(spark, folder, "mer ", "", now(4), compute)
    assert hit and {tuple(r) for r in again.collect()} == {(1, "é", None), (2, None, 2.5)}
    _, other = served.through_cache(spark, folder, "mer", "cursor", now(4), compute)
    _, old = served.through_cache(spark, folder, "mer", None, now(9), compute)  # five minutes for a rare query
    assert not other and not old
    stats = {r["query_text"]: r["search_count"] for r in stored.read_stored(spark, f"{folder}/stats").collect()}
    assert stats == {"mer": 4}
    assert served.clear_cache(spark, folder, now(10), 3) == 1 and stored.read_stored(spark, f"{folder}/cache").count() == 1
    assert served.clear_cache(spark, folder) == 1 and stored.read_stored(spark, f"{folder}/cache").count() == 0
    assert served.clear_cache(spark, str(tmp_path / "none")) == 0


def test_dashboards_as_json_and_back(spark):
    stats = spark.createDataFrame([(1, "a", 3, None), (1, "b", 0, 12.5), (2, "é", 1, 0.0)], "form long, label string, n long, p double")
    entries = served.stats_entries(stats, "form", F.lit("2031-01-01").cast("timestamp_ntz"))
    assert {r["cache_key"] for r in entries.collect()} == {"dashboard:1", "dashboard:2"}
    back = served.from_entries(entries, "form", "bigint", "label string, n bigint, p double")
    assert sorted(map(str, back.collect())) == sorted(map(str, stats.collect()))


def test_dry_runs_tell_and_write_nothing(spark, tmp_path):
    mapping = {"form": {"name": "f"}, "questions": [{"code": "c", "type": "single_choice", "source_column": "c", "options_from_values": True}]}
    rows = spark.createDataFrame([(f"v{i}",) for i in range(60)], "c string")
    said = {(r["kind"], r["name"]): r["value"] for r in served.dry_run(rows, mapping).collect()}
    assert said[("rows", "contributions")] == 60 and said[("many options", "c")] == 60
    assert ("many options", "c") not in {(r["kind"], r["name"]) for r in served.dry_run(rows.limit(50), mapping).collect()}
    assert {r["kind"] for r in served.dry_run(rows, {"questions": []}).collect()} <= {"error", "warning"}


def test_author_pages_search_inside(spark):
    long = " et une phrase qui est assez longue pour compter comme une réponse."
    answers = spark.createDataFrame([(i, 1, i, ("mer" if i % 2 else "port") + long) for i in range(9)] + [(20, 1, 0, "mer")], "id long, question_id long, contribution_id long, text string")
    given = spark.createDataFrame([(i, i // 6, None) for i in range(9)], "id long, author_id long, submitted_at timestamp_ntz")
    page = served.author_page(answers, given, 0, "mer", 1, 2).collect()
    assert [r["id"] for r in page] == [5, 3] and {(r["total"], r["pages"]) for r in page} == {(3, 2)}
    assert [r["id"] for r in served.author_page(answers, given, 0, "mer", 2, 2).collect()] == [1] and served.author_page(answers, given, 1).count() == 3


def test_plans_are_reported(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") % 7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    report = served.plan_report(df.where("id > 5").groupBy("v").count())
    assert "GreaterThan(id,5)" in report["scans"][0]["filters"] and report["exchanges"] == 1 and not report["all_pairs"]
    assert served.plan_report(df.crossJoin(df.toDF("a", "b")))["all_pairs"]
