"""Terms, pieces and stems counted by batch equal those of plain Python."""

import random
from collections import Counter

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from civicspark.functions import analyzers
from civicspark.functions.stem import stem, stems, stems_unaccented
from civicspark.functions.text import unaccent
from civicspark.operators import themes


def test_terms_are_counted_where_rows_are_read(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["mer", "port", "ville", "au"]) for _ in range(rng.randint(0, 9)))) for i in range(200)] + [(500, None), (501, "...")]
    for more in ([], [(None, "mer port"), (None, "mer"), (7, "mer mer"), (7, "port ville")]):
        want, held = Counter(), {}
        for key, text in rows + more:
            w = [x for x in (text or "").replace(".", "").split() if len(x) > 2]
            terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
            want.update(terms)
            for t in terms:
                held.setdefault(t, set()).add(key)
        out = themes.term_counts(spark.createDataFrame(rows + more, "id long, text string"), "id")
        assert {r["term"]: (r["rows"], r["occurrences"]) for r in out.collect()} == {t: (len(held[t]), n) for t, n in want.items() if len(held[t]) > 1}
    alone = themes.term_counts(spark.createDataFrame(rows, "id long, text string"), "id")
    assert "Generate" not in alone._jdf.queryExecution().optimizedPlan().toString()  # no row a term and document


def test_pieces_and_stems_equal_plain_ones(spark, monkeypatch):
    texts = ["Été à la mer", "", "a", None, "aaaa", "\U0001f600 x \U0001f600 x", "nationale Nations élèves œuvre ábc"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    got = {r[0]: r[1] for r in df.select("id", analyzers.grams("text")).collect()}
    assert all(sorted(got[i]) == sorted(analyzers.gram_list(t or "")) for i, t in enumerate(texts))
    monkeypatch.setattr(analyzers, "AT_ONCE", 5)
    assert [sorted(x) for x in analyzers._distinct(["ab", "", "aab"]).to_pylist()] == [sorted(analyzers.gram_list(t)) for t in ("ab", "", "aab")]
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), " ")
    for r in df.select(stems_unaccented(words).alias("a"), F.transform(stems(words), unaccent).alias("b"), words.alias("w")).collect():
        assert r["a"] == r["b"] and len(r["w"]) == len(r["a"])


def test_theme_terms_read_no_zeros(spark):
    rows = spark.createDataFrame([(0, Vectors.sparse(3, [0, 2], [1.0, 3.0])), (0, Vectors.dense([0.5, 0.0, 1.0])), (1, Vectors.sparse(3, [1], [2.0])), (1, Vectors.sparse(3, [], []))], ["theme", "features"])
    out = themes.theme_terms(rows, ["x", "y", "z"])
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, "z", 2.0), (0, 2, "x", 0.75), (1, 1, "y", 1.0)]
    assert "vector_to_array" not in out._jdf.queryExecution().analyzed().toString().lower() and "unwrap_udt" in out._jdf.queryExecution().analyzed().toString().lower()
