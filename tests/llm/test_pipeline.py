"""The pipeline's stages one after the other, on a small corpus with planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdeist") for _ in range(5)) for _ in range(n))
    item = text(30)
    docs = [(i, text(60), "en", f"s{i % 3}") for i in range(40)]
    docs += [(100, docs[0][1], "en", "s0"), (101, docs[1][1] + " more", "en", "s1"), (102, text(10) + " " + item + " " + text(9), "en", "s1"), (103, text(20) + " idiot moron " + text(9), "en", "s2"), (104, "x token=abcdefghijklmnop123 " + text(30), "en", "s2"), (105, None, "en", None)]
    d = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, d)
        seen[name] = {r["doc_id"]: r for r in out.collect()}
        if name != "mixing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = {r[0] for r in docs}
    assert set(seen["toxicity"]) == every - {103}
    assert set(seen["near_dup"]) == every - {103, 100, 101}
    assert set(seen["leaks"]) == set(seen["secrets"]) == set(seen["mixing"]) == every - {100, 101, 102, 103}
    assert "abcdefghijklmnop123" not in seen["secrets"][104]["text"] and seen["secrets"][5]["text"] == docs[5][1]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == set(seen["mixing"])


def test_empty_tables_repeated_rows_and_further_columns(spark, tmp_path):
    d = str(tmp_path)
    rows = [(1, "one text of some plain words here", "s", "x", 5), (1, "one text of some plain words here", "s", "x", 5), (2, None, None, None, None), (None, "another one, with a null for its id", "s", "y", 1), (3, "", "s", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, label string, id long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    out = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, d)
        assert out.columns == docs.columns, name
    assert sorted((r["doc_id"] or 0, r["label"] or "") for r in out.collect()) == [(0, "y"), (1, "x"), (2, ""), (3, "z")]
    docs.limit(0).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
