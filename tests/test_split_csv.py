"""Multi-line CSV files that are read in splits."""

import csv
import random

import pytest

from civicspark.sources import files


@pytest.mark.parametrize("size", ["97", "700", "128m"])
def test_rows_are_those_of_one_task(spark, tmp_path, size):
    rng, words = random.Random(3), ["a", 'say "x"', "one\ntwo", "\n\n", "é;,", "", "  b ", '"', "l\r\nm", "x" * 90 + "\n" + "y" * 150]
    rows = [[f"{n}-{i}", *(rng.choice(words) for _ in range(3))] for n in range(2) for i in range(120)]
    for n in range(2):
        with open(tmp_path / f"f{n}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\r\n" if n else "\n")
            out.writerow(["﻿id" if not n else "id", "t 1", "u", "v"])
            out.writerows(r for r in rows if r[0].startswith(f"{n}-"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.read_survey_split(spark, [str(tmp_path / "f0.csv"), str(tmp_path / "f1.csv")], order="place")
        got = df.orderBy("place").collect()
        tasks = df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert df.columns == ["id", "t 1", "u", "v", "place"] and (size != "97" or tasks > 50)
    clean = lambda x: x.replace("\r\n", "\n").strip()
    assert [[clean(x) for x in r[:4]] for r in got] == [[clean(x) for x in r] for r in rows]


def test_small_and_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n")
    (tmp_path / "b.csv").write_text('id;t\n1;"x\n')  # a cell that never ends
    (tmp_path / "c.csv").write_text("id,t\n1,x\n\n2\n")
    assert files.read_survey_split(spark, str(tmp_path / "a.csv")).count() == 0
    assert [r["id"] for r in files.read_survey_split(spark, str(tmp_path / "b.csv"), ";").collect()] == ["1"]
    assert [tuple(r) for r in files.read_survey_split(spark, str(tmp_path / "c.csv"), order="o").orderBy("o").drop("o").collect()] == [("1", "x"), ("2", "")]
