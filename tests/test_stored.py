"""Stored tables, counters under changes, deep places."""

import random

import pytest
from pyspark.sql import functions as F

from civicspark.operators import ingest, paging, stored
from civicspark.streaming import counters


def files_of(path):
    return {str(p) for p in path.rglob("rows/**/*.parquet")}


def test_merges_rewrite_touched_partitions_only(spark, tmp_path):
    path = tmp_path / "t"
    one = spark.createDataFrame([(i, f"n{i}", i) for i in range(200)] + [(None, "null", 0)], "k long, name string, n long")
    assert stored.merge_stored(str(path), one, ["k"], parts=16) == 16
    before = files_of(path)
    assert stored.merge_stored(str(path), one, ["k"], parts=99) == 0 and files_of(path) == before  # again: nothing
    two = spark.createDataFrame([(7, "new", None), (None, "again", 5), (900, "more", 1)], "k long, name string, n long")
    written = stored.merge_stored(str(path), two, ["k"], {"n": stored.fill})
    assert 1 <= written <= 3 and len(before - files_of(path)) <= 3
    got = {r["k"]: (r["name"], r["n"]) for r in stored.read_stored(spark, str(path)).collect()}
    assert got == {i: (f"n{i}", i) for i in range(200)} | {7: ("new", 7), None: ("again", 5), 900: ("more", 1)}
    assert stored.merge_stored(str(path), two, ["k"], stored.keep) == 0
    stored.merge_stored(str(path), spark.createDataFrame([(7, "x", -9), (8, "y", 2)], "k long, name string, n long"), ["k"], {"n": stored.add, "name": stored.keep})
    assert {tuple(r) for r in stored.read_stored(spark, str(path)).where("k IN (7, 8)").collect()} == {(7, "new", 0), (8, "n8", 10)}
    assert stored.merge_stored(str(path), two.limit(0), ["k"]) == 0


def test_a_broken_merge_is_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, i) for i in range(40)], "k long, n long")
    stored.merge_stored(path, rows, ["k"], parts=4)
    part = spark.read.parquet(f"{path}/rows").where("part_no = 1")
    part.withColumn("n", F.lit(-1).cast("long")).write.parquet(f"{path}/next")  # ready, but not yet in place
    import shutil

    shutil.rmtree(f"{path}/rows/part_no=1")  # and broken off after the old partition went
    held = {r["k"]: r["n"] for r in stored.read_stored(spark, path).collect()}
    assert len(held) == 40 and {k for k, n in held.items() if n == -1} == {k for k, n in held.items() if n != k} and not (tmp_path / "t/next").exists()
    spark.createDataFrame([(1, 1, 1)], "k long, n long, part_no int").write.parquet(f"{path}/next")
    (tmp_path / "t/next/_SUCCESS").unlink()  # not yet whole: of no effect
    assert {r["k"]: r["n"] for r in stored.read_stored(spark, path).collect()} == held


def test_a_survey_is_stored_once(spark, tmp_path):
    mapping = {"form": {"name": "f"}, "defaults": {"author": {"source_author_id": "who", "zipcode": "zip"}, "contribution": {"source_contribution_id": "id"}}, "questions": [{"code": "t", "type": "text", "source_column": "t"}, {"code": "c", "type": "single_choice", "source_column": "c", "options_from_values": True}]}
    one = spark.createDataFrame([("1", "x", "10", "first", "a"), ("2", "y", "20", "two", "b")], "id string, who string, zip string, t string, c string")
    two = spark.createDataFrame([("2", "y", "99", "changed", "b"), ("3", "x", "10", "three", "d")], "id string, who string, zip string, t string, c string")
    folder = str(tmp_path / "s")
    for rows in (one, two):
        stored.store_survey(ingest.ingest(rows, mapping), folder, 4)
    held = files_of(tmp_path / "s")
    assert not any(stored.store_survey(ingest.ingest(two, mapping), folder, 4).values()) and files_of(tmp_path / "s") == held
    read = {n: stored.read_stored(spark, f"{folder}/{n}") for n in stored.SURVEY}
    assert {n: df.count() for n, df in read.items()} == {"forms": 1, "questions": 2, "options": 3, "authors": 2, "contributions": 3, "answers": 6, "answer_options": 3}
    assert {r["zipcode"] for r in read["authors"].collect()} == {"10", "20"}  # an author's first file stays
    assert {r["text"] for r in read["answers"].where("text IS NOT NULL").collect()} == {"first", "a", "changed", "b", "three", "d"}


def test_counts_follow_inserts_moves_and_deletes(spark, tmp_path):
    rng, source = random.Random(5), tmp_path / "in"
    schema = "answer_id long, question_id long, op string, seq long"
    now, seq, changes = {}, 0, []
    for _ in range(4):
        batch = []
        for _ in range(60):
            a, seq = rng.randint(0, 25), seq + 1
            op = rng.choice(["insert", "update", "delete"])
            q = None if op == "delete" and rng.random() < 0.5 else rng.choice([1, 2, 3, None]) if op == "update" else rng.randint(1, 3)
            batch.append((a, q, op, seq))
            now.pop(a, None)
            if op != "delete" and q is not None:
                now[a] = q
        changes.append(batch)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run(batches):
        for b in batches:
            rng.shuffle(b)  # seq orders them
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        counters.keep_changed_counts(stream, out, ck).awaitTermination()

    run(changes[:2])
    run(changes[2:])  # a restart goes on where it was
    got = {r["question_id"]: r["answers_count"] for r in counters.read_question_counts(spark, out).collect()}
    assert {q: n for q, n in got.items() if n} == {q: list(now.values()).count(q) for q in set(now.values())}
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("v")]) == 2
    with pytest.raises(ValueError, match="another checkpoint"):
        counters.keep_changed_counts(spark.readStream.schema(schema).parquet(str(source)), out, str(tmp_path / "ck2"))


@pytest.mark.parametrize(("keys", "most"), [([("at", "desc"), ("id", "desc")], 5), ([("at", "asc"), ("id", "asc")], 40), ([("id", "asc")], 3)])
def test_deep_pages_are_the_sorted_rows(spark, keys, most):
    rng = random.Random(1)
    rows = [(i * 7 - 300, rng.choice([None, 5, 5, 5, *range(400)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, n int").withColumn("at", F.expr("timestamp_micros(n * 1000000000L)")).drop("n")
    whole = [r["id"] for r in df.orderBy(*paging.ordered(keys)).collect()]
    for offset in (0, 1, 17, 250, 487, 499, 500, 9000):
        assert [r["id"] for r in paging.deep_page(df, keys, offset, 13, most).collect()] == whole[offset : offset + 13]
    assert paging.deep_page(df.limit(0), keys, 4).count() == 0
    with pytest.raises(TypeError):
        paging.deep_page(df.withColumn("id", F.col("id").cast("string")), [("id", "asc")], 4)


@pytest.mark.parametrize("k", [1, 40, 101, 5000])
def test_deep_kth_of_each_group(spark, k):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 3, *range(90)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, n int")
    for way in ("asc", "desc"):
        keys = [("n", way), ("id", way)]
        got = {r["g"]: (r["id"], r["k"], r["total"]) for r in paging.kth_deep(df, "g", keys, k).collect()}
        whole = df.orderBy(*paging.ordered(keys)).collect()
        groups = {g: [r["id"] for r in whole if r["g"] == g] for g in ("a", "b", None)}
        assert got == {g: (own[min(k, len(own)) - 1], min(k, len(own)), len(own)) for g, own in groups.items()}


def test_rows_of_a_file_are_made_once_for_all_tables(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text

    given = [(1, "a", "x", "red"), (2, "a", "x", "blue"), (2, "a", "x", "blue"), (3, "b", "y, z", None)]
    rows = spark.createDataFrame(given, "line int, `id; no` string, who string, c string").coalesce(1).withColumn("c", seen("c"))
    mapping = {"form": {"name": "f"}, "defaults": {"author": {"source_author_id": "who"}, "contribution": {"source_contribution_id": "id; no"}}, "questions": [{"code": "c", "type": "single_choice", "source_column": "c", "options_from_values": True}]}
    found, made = [], []
    for keep in (None, str(tmp_path / "file")):
        calls.value, folder = 0, str(tmp_path / f"survey{keep is None}")
        stored.store_survey(ingest.ingest(rows, mapping, order="line", keep=keep), folder, 2)
        made.append(calls.value)
        found.append({name: sorted(map(str, stored.read_stored(spark, f"{folder}/{name}").collect())) for name in stored.SURVEY})
    assert found[0] == found[1] and len(found[0]["answers"]) == 1
    assert made[1] <= 2 * len(given) < made[0]
