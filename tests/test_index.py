"""The stored index, moods, ingest order and small readers."""

import random
import re

from pyspark.sql import functions as F

from civicspark.functions import match
from civicspark.operators import index, ingest, search, themes
from civicspark.sources import files


def test_index_answers_as_the_text_does(spark, tmp_path):
    rng = random.Random(2)
    words = ["Été", "la", "the", "of", "mer", "merle", "x1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(900, None), (901, "...")]
    df = spark.createDataFrame(rows, "id long, text string")
    index.build_index(df, str(tmp_path / "ix"), buckets=4)
    ix = index.open_index(spark, str(tmp_path / "ix"), 4)
    plain = search.with_terms(df)
    for ask in (
        lambda t: match.plain_query(t, "la mer"), lambda t: match.web_query(t, '"the of" or ete -la'), lambda t: match.web_query(t, "-the"), lambda t: match.expression_query(t, 'mer* AND NOT ("of the" OR x1)'.replace("AND NOT", "NOT")),
        lambda t: match.plain_query(t, ""), lambda t: match.web_query(t, "nothing"), lambda t: match.expression_query(t, '"la la la"'),
    ):
        got = sorted(r["key"] for r in index.matches(ix, ask).collect())
        want = sorted(r["id"] for r in plain.where(ask(match.Terms(F.col("tokens")))).collect())
        assert got == want
    plan = index.matches(ix, lambda t: match.plain_query(t, "merle"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "EqualTo(term,merle)" in plan.replace(" ", "") or "In(term" in plan
    assert ix.n == 302 and index.matches(index.open_index(spark, str(tmp_path / "ix"), 4), lambda t: match.plain_query(t, "zzz")).count() == 0


def test_mood_is_learnt_from_labels(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        y = i % 2
        rows.append((i, " ".join(rng.choice(["maison", "ville", "route", "école"]) for _ in range(8)) + (" merci bravo" if y and i % 5 else " honte scandale" if not y and i % 5 else ""), y))
    df = spark.createDataFrame(rows, "id long, text string, y int")
    got = themes.learnt_mood(df.select("id", "text"), df.where("id < 200"), "y").join(df, "id").where("id >= 200 AND id % 5 > 0").collect()
    assert sum((r["mood"] == "positive") == (r["y"] == 1) for r in got) / len(got) > 0.95
    assert themes.learnt_mood(spark.createDataFrame([(1, None)], "id long, text string"), df, "y").count() == 1


def test_first_and_last_rows_go_by_file_order(spark, tmp_path):
    for n, lines in (("a", ["id,who,zip,t", "1,x,10,first", "2,x,20,two"]), ("b", ["id,who,zip,t", "1,y,30,last", "3,x,40,"])):
        (tmp_path / f"{n}.csv").write_text("\n".join(lines) + "\n")
    rows = files.read_survey(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], order="place", multi_line=False)
    mapping = {"form": {"name": "f"}, "defaults": {"author": {"source_author_id": "who", "zipcode": "zip"}, "contribution": {"source_contribution_id": "id"}}, "questions": [{"code": "t", "type": "text", "source_column": "t"}]}
    s = ingest.ingest(rows, mapping, order="place")
    assert {(r["source_author_id"], r["zipcode"]) for r in s.authors.collect()} == {("x", "10"), ("y", "30")}
    texts = {r["source_contribution_id"]: r["text"] for r in s.contributions.join(s.answers, F.col("contribution_id") == s.contributions["id"], "left").collect()}
    assert texts == {"1": "last", "2": "two", "3": None}
    merged = ingest.ingest(rows, mapping, order="place", merge=True)
    assert {r["text"] for r in merged.answers.collect()} == {"first\n\nlast", "two"}


def test_urls_of_databases():
    assert files.jdbc_options("postgres://u%40x:p@h:5432/db") == {"url": "jdbc:postgresql://h:5432/db", "user": "u@x", "password": "p"}
    assert files.jdbc_options("postgresql+psycopg2://h/db") == {"url": "jdbc:postgresql://h/db"}
    assert files.jdbc_options("jdbc:sqlite:x") == {"url": "jdbc:sqlite:x"}


def test_null_marks_do_not_withdraw_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, " TRUE", "kept"), (3, "0", "Deleted"), (4, "", " Kept ")], "id int, trashed string, trashedStatus string")
    assert sorted(r["id"] for r in ingest.kept_rows(df).collect()) == [1, 4]
