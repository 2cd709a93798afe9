"""Queries of the stored indexes: changes, nearness, the best rows by block maxima, substrings, similarity, fragments. Roles as in `catalog`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import analyzers, highlight, match
from ..operators import grams, index
from ..storage import remove, shared_dir
from .catalog import TOKENS, _bm25_sql, indexed, query, read


def near_sql(tokens: str, phrases: list[str], most: int) -> str:
    """NEAR over a list of tokens: some phrase begins, and every other one ends at most `most` words before."""
    lists = []
    for p in phrases:
        words = p.split()
        lists.append((f"list_filter(range(1, len({tokens}) + 1), lambda i: " + " AND ".join(f"{tokens}[i + {j}] = '{w}'" for j, w in enumerate(words)) + ")", len(words)))
    cases = []
    for i, (own, _) in enumerate(lists):
        others = " AND ".join(f"len(list_filter({o}, lambda y: y <= x AND x - y - {n} <= {most})) > 0" for j, (o, n) in enumerate(lists) if j != i)
        cases.append(f"len(list_filter({own}, lambda x: {others})) > 0")
    return "(" + " OR ".join(cases) + ")"


@query(f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE {near_sql('t', ['the', 'with'], 3)} OR {near_sql('t', ['of the', 'and', 'that'], 8)}")
def fts_near(spark, d):
    return index.matches(indexed(spark, d), lambda t: match.expression_query(t, 'the NEAR/3 with OR NEAR("of the" and that, 8)')).select(F.col("key").alias("doc_id"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE {near_sql('t', ['that', 'with'], 2)} AND NOT {near_sql('t', ['of', 'the'], 0)}")
def fts_near_unindexed(spark, d):
    rows = read(spark, d, "documents").select("doc_id", analyzers.simple_tokens("text").alias("t"))
    return rows.where(match.expression_query(match.Terms(F.col("t")), "that NEAR/2 with NOT NEAR(of the, 0)")).select("doc_id")


@query(_bm25_sql(["la", "with", "ciudad"], 50))
def fts_top_bm25(spark, d):
    return index.best_bm25(indexed(spark, d), "La with ciudad").rows.select(F.col("key").alias("doc_id"), "score")


@query(_bm25_sql(["that", "est", "und"], 20))
def fts_top_bm25_20(spark, d):
    return index.best_bm25(indexed(spark, d), "that est und", 20).rows.select(F.col("key").alias("doc_id"), "score")


CHANGED = "(SELECT doc_id, text FROM documents WHERE lang NOT IN ('fr', 'de') UNION ALL SELECT doc_id, text || ' ajout final' FROM documents WHERE lang = 'fr' UNION ALL SELECT item_id + 1000000000, text FROM benchmark)"


@query(_bm25_sql(["ajout", "the", "und"], 60).replace("FROM documents", f"FROM {CHANGED}"))
def fts_changed_index(spark, d):
    """An index of all documents, then one batch that changes and deletes, one that adds, and a merge; the best rows of the last version."""
    path, docs = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", read(spark, d, "documents").select("doc_id", "text", "lang")
    index.build_index(docs, path, "text", "doc_id")
    french = docs.where("lang = 'fr'").withColumn("text", F.concat("text", F.lit(" ajout final")))
    index.change_index(spark, path, french, docs.where("lang = 'de'"), "text", "doc_id")
    index.change_index(spark, path, read(spark, d, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id"), "text"), text="text", key="doc_id")
    index.merge_index(spark, path)
    index.sweep_index(spark, path)
    found = index.best_bm25(index.open_index(spark, path), "ajout the und", 60).rows.collect()  # 60 rows: the index goes with this call
    remove(spark, path)
    return spark.createDataFrame([(r["key"], r["score"]) for r in found], "doc_id long, score double")


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%Tion THE%' OR text ILIKE '%iudad%'")
def text_contains(spark, d):
    """Parts of words in any case, by the index of three-letter pieces."""
    docs = read(spark, d, "documents")
    held = index.index_of(docs.select("doc_id", "text"), "text", "doc_id", analyzers.grams)
    rows = docs.select("doc_id", "source", "text")
    return grams.containing(held, rows, "Tion THE", "text", "doc_id").union(grams.containing(held, rows, "iudad", "text", "doc_id")).select("doc_id", "source").distinct()


PIECES = "list_distinct(list_transform(range(1, length(s) - 1), lambda i: s[i:i + 2]))"


@query(f"""WITH a AS (SELECT p_partkey, '  ' || lower(p_name) || ' ' AS s FROM part), g AS (SELECT p_partkey, {PIECES} AS g FROM a), q AS (SELECT {PIECES} AS h FROM (SELECT '  small rings ' AS s))
SELECT p_partkey AS id, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS similarity FROM g, q WHERE len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) >= 0.3""")
def similar_names(spark, d):
    parts = read(spark, d, "part").select("p_partkey", "p_name")
    held = index.index_of(parts, "p_name", "p_partkey", analyzers.grams)
    return grams.similar(held, "Small rings").select(F.col("key").alias("id"), "similarity")


KINDS = ["the", "with", "la", "ciudad"]


def fragment_sql(kinds: list[str]) -> str:
    """doc_id and the best stretch of 18 words (`highlight.best_fragment`) of each document."""
    last = ", ".join(f"list_max(list_filter(h, lambda x: x <= e AND x > e - 18 AND k[x] = {j}))" for j in range(1, len(kinds) + 1))
    return rf"""SELECT doc_id, coalesce(array_to_string(list_transform(range(p, least(p + 18, len(w) + 1)), lambda i: CASE WHEN k[i] > 0 THEN '<mark>' || w[i] || '</mark>' ELSE w[i] END), ' '), '') AS part FROM (
SELECT doc_id, w, k, CASE WHEN s IS NULL THEN 1 ELSE greatest(1, least(b - (18 - z) // 2, len(w) - 17)) END AS p FROM (
SELECT doc_id, w, k, s, 10000000000 - s % 10000000000 AS b, (CAST(ceil(s / 1000000000000.0) AS BIGINT) * 1000000000000 - s) // 10000000000 + 1 AS z FROM (
SELECT doc_id, w, k, list_max(list_transform(range(1, len(h) + 1), lambda i: len(f[i])::BIGINT * 1000000000000 - (h[i] - list_min(f[i])) * 10000000000 - list_min(f[i]))) AS s FROM (
SELECT doc_id, w, k, list_transform(h, lambda e: list_filter([{last}], lambda x: x IS NOT NULL)) AS f, h FROM (
SELECT *, list_filter(range(1, len(k) + 1), lambda i: k[i] > 0) AS h FROM (
SELECT doc_id, w, list_transform(w, lambda x: coalesce(list_position({kinds}, strip_accents(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]', '', 'g'))), 0)) AS k FROM (
SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)))))))"""


@query(fragment_sql(KINDS))
def best_fragment(spark, d):
    return read(spark, d, "documents").select("doc_id", highlight.best_fragment("text", KINDS, stemmed=False).alias("part"))
