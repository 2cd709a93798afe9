"""Changes to a stored index, its session cache, nearness, the best rows, pieces, stems and fragments."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from civicspark.functions import analyzers, highlight, match
from civicspark.functions.stem import stem
from civicspark.operators import grams, index, search

WORDS = ["Été", "la", "the", "of", "mer", "merle", "x1", "port"]


def texts(spark, n, seed=1, start=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(start + i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in range(n)], "id long, text string")


def rows_of(ix, k=20):
    asks = (lambda t: match.plain_query(t, "la mer"), lambda t: match.web_query(t, "-the"), lambda t: match.expression_query(t, 'mer* AND "of the"'))
    found = [sorted(r[0] for r in index.matches(ix, a).collect()) for a in asks]
    scores = {r["key"]: round(r["score"], 6) for r in index.indexed_bm25(ix, "mer port").collect()}
    best = [(r["key"], r["score"]) for r in index.best_bm25(ix, "mer port", k).rows.collect()]
    assert best == sorted(((k, s) for k, s in scores.items()), key=lambda x: (-x[1], -x[0]))[:k]
    return found, scores, best, ix.n, round(ix.mean, 9)


def test_changed_index_equals_a_rebuilt_one(spark, tmp_path):
    path, rng = str(tmp_path / "ix"), random.Random(4)
    now = {r["id"]: r["text"] for r in texts(spark, 200).collect()}
    index.build_index(spark.createDataFrame(list(now.items()), "id long, text string"), path, buckets=4, spread=2)
    before = rows_of(index.open_index(spark, path))
    for turn in range(3):
        new = {rng.randint(0, 260): " ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(20)}
        gone = [rng.randint(0, 220) for _ in range(15)] + [next(iter(new))]  # deleted and changed at once is changed
        for k in gone:
            now.pop(k, None)
        now |= new
        changed, deleted = spark.createDataFrame(list(new.items()), "id long, text string"), spark.createDataFrame([(k,) for k in gone], "id long")
        assert index.change_index(spark, path, changed, deleted) == turn + 1
    index.change_index(spark, path, deleted=spark.createDataFrame([(999_999,)], "id long"))
    other = str(tmp_path / "other")
    index.build_index(spark.createDataFrame(list(now.items()), "id long, text string"), other, buckets=4)
    want = rows_of(index.open_index(spark, other))
    assert rows_of(index.open_index(spark, path)) == want
    assert rows_of(index.open_index(spark, path, version=0)) == before  # readers of a version see no later change
    assert index.merge_index(spark, path) == 5 and rows_of(index.open_index(spark, path)) == want
    index.sweep_index(spark, path)
    assert index.versions(spark, path) == [5] and sorted(p.name for p in (tmp_path / "ix").iterdir() if p.is_dir()) == ["s5", "versions"]
    assert rows_of(index.open_index(spark, path)) == want and index.change_index(spark, path) == 5
    index.change_index(spark, path, deleted=spark.createDataFrame([(k,) for k in now], "id long"))
    assert index.open_index(spark, path).n == 0 and not index.best_bm25(index.open_index(spark, path), "mer").rows.count()


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    path = tmp_path / "ix"
    index.build_index(texts(spark, 300), str(path), buckets=4)
    held = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    index.change_index(spark, str(path), texts(spark, 2, 9, start=5), spark.createDataFrame([(7,)], "id long"))
    assert held == {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet") if p in held}
    assert spark.read.parquet(f"{path}/s1/docs").count() == 2 and spark.read.parquet(f"{path}/gone1").count() == 3


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "ix")
    index.build_index(texts(spark, 5), path, buckets=2)
    index._write_version(spark, path, 1, {})
    with pytest.raises(Exception, match="[Ee]xist"):
        index._write_version(spark, path, 1, {})


def test_kept_indexes_are_of_the_very_table(spark, tmp_path):
    source = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "la mer", "a"), (2, "le port", "b"), (3, "mer", "b")], "id long, text string, kind string").coalesce(1).write.parquet(source)
    df = spark.read.parquet(source)
    assert index.index_of(df.where("kind = 'b'")).n == 2 and index.index_of(df).n == 3 and index.index_of(spark.read.parquet(source)) is index.index_of(df)
    one, two = (lambda c: F.split(F.col(c), " ")), (lambda c: F.array(F.col(c)))
    assert index.index_of(df, analyzer=one).postings.count() == 5 and index.index_of(df, analyzer=two).postings.count() == 3
    path = index.index_of(df).docs.inputFiles()[0].removeprefix("file://").split("/s0/")[0]
    part = next(p for p in (tmp_path / "t.parquet").iterdir() if p.suffix == ".parquet")
    spark.createDataFrame([(9, "autre", "c")], "id long, text string, kind string").coalesce(1).write.parquet(str(tmp_path / "u"))
    shutil.copy(next(p for p in (tmp_path / "u").iterdir() if p.suffix == ".parquet"), part)  # other rows under the same name
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    again = spark.read.parquet(source)
    assert index.index_of(again).n == 1
    import os

    assert not os.path.exists(path)


def test_best_rows_read_few_blocks(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(["fond"] * (i % 3) + [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(5, 400))])) for i in range(3000)]
    rows[77] = (77, "fond fond fond fond")
    rows[78] = (78, "fond " * 9 + "w1")
    index.build_index(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "ix"), buckets=2)
    ix = index.open_index(spark, str(tmp_path / "ix"))
    best = index.best_bm25(ix, "fond", 5)
    want = sorted(((r["key"], round(r["score"], 6)) for r in index.indexed_bm25(ix, "fond").collect()), key=lambda x: (-x[1], -x[0]))[:5]
    assert [tuple(r) for r in best.rows.collect()] == want and best.all == 2001 and best.read < best.all / 5
    plan = best.rows._jdf.queryExecution().toString()
    assert "block" in plan and "PushedFilters" in plan
    assert index.best_bm25(ix, "nowhere", 5).rows.count() == 0 and index.best_bm25(ix, "...", 5).all == 0
    assert index.best_bm25(ix, "fond", 5000).read == 2001  # fewer than k documents: all are read


@pytest.mark.parametrize("most", [0, 1, 3, 10])
def test_nearness_equals_brute_force(spark, tmp_path, most):
    df = texts(spark, 150, 6)
    index.build_index(df, str(tmp_path / "ix"), buckets=2)
    ix, plain = index.open_index(spark, str(tmp_path / "ix")), search.with_terms(df)
    phrases = [["la", "mer"], ["port"], ["x1"]]

    def hit(tokens):
        at = [[(i, i + len(p)) for i in range(len(tokens)) if tokens[i : i + len(p)] == p] for p in phrases]
        return all(at) and any(a[0] - o[1] <= most and b[0] - o[1] <= most and c[0] - o[1] <= most for a in at[0] for b in at[1] for c in at[2] for o in [min((a, b, c), key=lambda x: x[1])])

    want = sorted(r["id"] for r in plain.collect() if hit(r["tokens"]))
    ask = lambda t: match.expression_query(t, f'NEAR("la mer" port x1, {most})')
    assert sorted(r["key"] for r in index.matches(ix, ask).collect()) == sorted(r["id"] for r in plain.where(ask(match.Terms(F.col("tokens")))).collect()) == want


def test_near_grammar():
    class Said:
        def near(self, phrases, most):
            return f"N{most}{phrases}"

        def word(self, w):
            return w

        def phrase(self, p):
            return " ".join(p)

        def prefix(self, p):
            return p

    q = lambda text: match.expression_query(Said(), text)
    assert q("culture NEAR/5 patrimoine") == "N5[['culture'], ['patrimoine']]" and q("NEAR(a b)") == "N10[['a'], ['b']]"
    assert q('NEAR("a b",c , 2)') == "N2[['a', 'b'], ['c']]" and q("NEAR") == "near" and q("NEAR(a a, 3)") == "a" and q("a NEAR a") == "a"
    for bad in ("NEAR(", "NEAR()", "(a) NEAR b", "a* NEAR b", "NEAR(a*, b)"):
        with pytest.raises(ValueError):
            q(bad)


def test_pieces_find_what_a_scan_finds(spark, tmp_path):
    rows = [(1, "Le Maire%de_Paris"), (2, "mair"), (3, None), (4, ""), (5, "un MAIRE"), (6, "ma re"), (7, "de_p"), (8, "DeXP 😀!")]
    df = spark.createDataFrame(rows, "id long, text string")
    index.build_index(df, str(tmp_path / "g"), analyzer=analyzers.grams, buckets=4)
    ix = index.open_index(spark, str(tmp_path / "g"))
    for q in ("Maire", "de_P", "e%d", "ma", "", " ", "😀!", "absent"):
        assert sorted(r["id"] for r in grams.containing(ix, df, q).collect()) == [i for i, t in rows if t is not None and q.lower() in t.lower()]
    plan = grams.containing(ix, df, "maire")._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = {r["id"]: r["s"] for r in df.where("text IS NOT NULL").select("id", search.similarity(F.col("text"), F.lit("Maire")).alias("s")).collect()}
    assert {r["key"]: r["similarity"] for r in grams.similar(ix, "Maire", 0.2).collect()} == pytest.approx({k: s for k, s in want.items() if s >= 0.2})
    index.change_index(spark, str(tmp_path / "g"), spark.createDataFrame([(1, "rien"), (9, "maires")], "id long, text string"), analyzer=analyzers.grams)
    assert sorted(r["key"] for r in grams.similar(index.open_index(spark, str(tmp_path / "g")), "maire", 0.3).collect()) == [2, 5, 6, 9]


# Words and stems that the stemmer's public description shows.
STEMS = """continu continu continuait continu continuation continu continuel continuel continuellement continuel continuité continu continuons continuon contorsions contors
contournait contourn contractions contract contradictoirement contradictoir contraindre contraindr main main maintenaient mainten maintenir mainten maintenue maintenu maintien
maintien maire mair mairie mair mais mais maïs maï maisons maison maîtresse maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeure majeur
majordomes majordom majorités major malacca malacc maladie malad maladive malad""".split()


def test_stems_of_the_public_list():
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert stem("") == "" and stem("y") == "y" and stem("qu") == "qu" and stem("éé") == stem("éé")


def test_questions_and_texts_have_the_same_stems(spark, tmp_path):
    rows = [(1, "Le maire de la ville."), (2, "Les maires, vraiment !"), (3, "Une mairie à Évian"), (4, None), (5, "Là où naturellement")]
    df = spark.createDataFrame(rows, "id long, text string")
    index.build_index(df, str(tmp_path / "s"), analyzer=analyzers.analyze_fr, buckets=2)
    ix = index.open_index(spark, str(tmp_path / "s"))
    find = lambda q: sorted(r["key"] for r in index.matches(ix, lambda t: match.web_query(t, q, analyzers.query_stems)).collect())
    assert find("le maire") == find("maires") == find("les maires de la") == [1, 2, 3] and find("évian -ville") == [3] and find("le la") == [] and find("naturel") == [5]
    got = df.select(analyzers.analyze_fr("text").alias("t"), analyzers.analyze_fr("text", unaccent_first=True).alias("u")).collect()
    assert [r["t"] for r in got[:4]] == [["mair", "vill"], ["mair", "vrai"], ["mair", "evian"], []]
    assert all(a in analyzers.query_stems(t or "") for (_, t), r in zip(rows, got, strict=True) for a in r["t"])


def test_best_fragment_is_not_the_first_hit(spark):
    filler = " ".join(["mot"] * 30)
    text = f"maire {filler} les maires et la ville {filler} ville"
    df = spark.createDataFrame([(text,), ("rien du tout",), ("",), (None,), ("ville",)], "text string")
    terms = analyzers.query_stems("le maire de la ville")
    got = [r[0] for r in df.select(highlight.best_fragment("text", terms, 8)).collect()]
    assert got == ["mot les <mark>maires</mark> et la <mark>ville</mark> mot mot", "rien du tout", "", "", "<mark>ville</mark>"]
    assert [r[0] for r in df.select(highlight.best_fragment("text", [], 2)).collect()] == ["maire mot", "rien du", "", "", "ville"]
