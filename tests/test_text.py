"""Text scalars on the edge cases of the fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from civicspark.functions import text
from civicspark.functions.highlight import highlight_one
from civicspark.functions.match import Terms, expression_query, plain_query, web_query
from civicspark.operators import paging
from civicspark.operators.search import with_terms


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "v string").select(make("v").alias("o")).first()["o"]


@pytest.mark.parametrize(("value", "want"), [(None, ""), ("", ""), ("École & œuvre", "ecole-oeuvre"), ("Ægir", "aegir"), ("---", "contenu"), ("😀", "contenu"), ("x" * 100, "x" * 60), ("a" * 59 + " bcd", "a" * 59)])
def test_slugify(spark, value, want):
    assert one(spark, text.slugify, value) == want
    assert one(spark, text.slugify, want) == want


@pytest.mark.parametrize(("value", "want"), [("Titre : Objet: le sujet", "le sujet"), ("  titre de la contribution - idée", "idée"), ("le Objet: reste", "le Objet: reste"), ("Thématique: - vélo", "vélo")])
def test_boilerplate(spark, value, want):
    assert one(spark, text.strip_boilerplate, value) == want


def test_segments_and_excerpts(spark):
    assert one(spark, text.dedupe_segments, "un mot … un mot … deux , trois …") == "un mot … deux, trois"
    assert one(spark, lambda c: text.clean_excerpt(c, 20), "<b>court</b>\r\n texte") == "court texte"
    assert one(spark, lambda c: text.clean_excerpt(c, 20), "Une phrase longue. Puis encore") == "Une phrase longue."
    assert one(spark, lambda c: text.clean_excerpt(c, 20), "Oui. Une phrase plus longue ici") == "Oui. Une phrase…"
    assert one(spark, lambda c: text.clean_excerpt(c, 5), "abcdefgh") == "abcde…"
    assert one(spark, text.clean_excerpt, None) == ""


@pytest.mark.parametrize(("value", "want"), [("1", True), ("true", True), ("Vrai", True), (" oui ", True), ("checked", True), ("0", False), ("3", True), ("-1", False), ("", False), (None, False)])
def test_truthy(spark, value, want):
    assert one(spark, text.truthy, value) is want


def test_fields(spark):
    assert [one(spark, text.clean_zipcode, v) for v in ("75001", " 75 001 ", "7500", "750011", "")] == ["75001", "75001", None, "75001", None]
    assert one(spark, text.parse_datetime, "2019-01-22 09:37:11") == datetime.datetime(2019, 1, 22, 9, 37, 11)
    assert one(spark, text.parse_datetime, "KO") is None
    assert [spark.range(1).select(text.ttl_minutes(F.lit(n))).first()[0] for n in (1, 4, 5, 10, 20, 50, 100, 1000)] == [5, 5, 15, 15, 30, 30, 45, 60]
    assert one(spark, lambda c: text.cache_key(c, F.lit("")), "  Vélo ") == "search:fts:vélo:"
    assert one(spark, lambda c: text.cache_key(c, F.lit("x")), "") == "search:timeline:x"
    assert len(one(spark, lambda c: text.cache_key(c, F.lit("x")), "q" * 300)) <= 100
    assert one(spark, lambda c: text.valid_text(c, 3), "  ab ") is False


def test_highlight():
    assert highlight_one("Le vélo en ville", "velo") == "Le vélo en ville"
    assert highlight_one("Le vélo en ville", "VÉLO v") == "Le <mark>vélo</mark> en ville"
    assert highlight_one("transports et train", "tra") == "<mark>transports</mark> et <mark>train</mark>"
    assert highlight_one("a " * 30 + "but", "but").startswith("a a") and highlight_one(None, "x") == ""


def test_search_grammars(spark):
    rows = with_terms(spark.createDataFrame([(1, "Le Vélo électrique en ville"), (2, "la ville sans voiture"), (3, "électricité"), (4, None)], "id int, text string"))
    found = lambda make, q: sorted(r["id"] for r in rows.where(make(Terms(F.col("tokens")), q)).collect())
    assert found(plain_query, "VELO ville") == [1]
    assert found(plain_query, "!!!") == []
    assert found(web_query, "ville -velo") == [2]
    assert found(web_query, '"velo electrique" or voiture') == [1, 2]
    assert found(web_query, 'ville "') == [1, 2]
    assert found(web_query, "日本 😀" * 300) == []
    assert found(expression_query, "(velo OR voiture) AND ville") == [1, 2]
    assert found(expression_query, "electri* NOT velo") == [3]
    with pytest.raises(ValueError):
        expression_query(Terms(F.col("tokens")), "(velo")


def test_cursor_and_pages(spark):
    assert paging.decode_cursor(paging.encode_cursor({"id": 3})) == {"id": 3}
    assert [paging.decode_cursor(x) for x in (None, "", "%%%", "bnVsbA", "YWJj")] == [None] * 5
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"2019-01-{1 + i % 5:02d}") for i in range(50)], "id int, at string")
    keys, cursor, seen, sizes = [("at", "desc"), ("id", "desc")], None, [], []
    while True:
        rows, more, cursor = paging.paginate(df, keys, cursor)
        seen += [r["id"] for r in rows]
        sizes.append(len(rows))
        if not more:
            break
    assert sizes == [20, 20, 10] and sorted(seen) == list(range(50))
    assert seen == [r["id"] for r in df.orderBy(*paging.ordered(keys)).collect()]
