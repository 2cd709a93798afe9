"""All queries by name, with the SQL that gives the same rows where SQL can.

The survey's roles on the test tables: documents are answers (question = source, type = lang), orders are
contributions, customers authors, nations questions or options, regions forms, events log lines and searches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analyzers, highlight, match, text
from ..operators import caches, choices, index, ingest, logs, paging, rollups, search, themes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("question_id"), F.col("lang").alias("type"), "text")


def options(spark, d) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_regionkey").alias("question_id"), F.col("n_nationkey").alias("option_id"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("position"))


def picks(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("option_id"))


#: Answers of the SQL side, by the same names.
ANSWERS = "(SELECT doc_id AS id, source AS question_id, lang AS type, text FROM documents)"
TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
PICKS = "SELECT n.n_regionkey AS question_id, n.n_nationkey AS option_id, n.n_name AS label, n.n_nationkey AS position, count(c.c_custkey) AS count FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY ALL"


def pct(a: str, b: str) -> str:
    return f"CAST(round(CAST({a} AS DECIMAL(20,0)) * 100 / CAST({b} AS DECIMAL(20,0)), 2) AS DOUBLE)"


# ---- choice statistics


@query(f"SELECT *, coalesce({pct('count', 'nullif(sum(count) OVER (PARTITION BY question_id), 0)')}, 0.0) AS percentage FROM ({PICKS})")
def single_choice_stats(spark, d):
    return choices.single_choice_stats(options(spark, d), picks(spark, d))


@query(f"""SELECT question_id, option_id, label, position, count, coalesce({pct('count', 'nullif(total, 0)')}, 0.0) AS percentage FROM (
  SELECT *, sum(count) OVER (PARTITION BY question_id) AS total, row_number() OVER (PARTITION BY question_id ORDER BY position, option_id) AS r FROM ({PICKS})) WHERE r <= 3""")
def single_choice_top(spark, d):
    return choices.single_choice_stats(options(spark, d), picks(spark, d), top=3)


@query(f"""SELECT question_id, option_id, label, position, count, coalesce({pct('count', 'nullif(sum(count) OVER (PARTITION BY question_id), 0)')}, 0.0) AS percentage FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY position, option_id) AS r FROM ({PICKS})) WHERE r <= 3""")
def single_choice_top_of_kept(spark, d):
    return choices.single_choice_stats(options(spark, d), picks(spark, d), top=3, of_top=True)


MULTI = f"""WITH a AS (SELECT * FROM {ANSWERS} WHERE contains(text, '|')),
r AS (SELECT question_id, count(*) AS responses FROM a GROUP BY 1),
c AS (SELECT question_id, label, count(*) AS count FROM (SELECT question_id, regexp_replace(unnest(string_split(text, '|')), '^\\s+|\\s+$', '', 'g') AS label FROM a) WHERE label <> '' GROUP BY 1, 2)
SELECT question_id, label, count, responses, {pct('count', 'responses')} AS percentage FROM c JOIN r USING (question_id)"""


@query(MULTI)
def multi_choice_stats(spark, d):
    return choices.multi_choice_stats(answers(spark, d))


@query(f"SELECT question_id, label, count, responses, percentage FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY count DESC, label) AS r FROM ({MULTI})) WHERE r <= 10")
def multi_choice_top10(spark, d):
    return choices.multi_choice_stats(answers(spark, d), top=10)


@query(f"""SELECT question_id, total, pipes, uniques, {pct('pipes', 'total')} AS pipe_pct, {pct('uniques', 'total')} AS unique_pct,
  CASE WHEN total >= 10 AND pipes >= 1 THEN CASE WHEN p >= 40 OR p >= 20 AND pipes >= 10 OR p >= 5 THEN 'multi_choice' END WHEN pipes >= 0.5 AND p >= 50 THEN 'multi_choice' WHEN total >= 10 AND uniques <= 10 AND uniques * 100.0 / total <= 0.1 THEN 'single_choice' END AS suggested,
  CASE WHEN total >= 10 AND pipes >= 1 THEN CASE WHEN p >= 40 THEN 'high' WHEN p >= 20 AND pipes >= 10 THEN 'medium' WHEN p >= 5 THEN 'medium' END WHEN pipes >= 0.5 AND p >= 50 THEN 'medium' WHEN total >= 10 AND uniques <= 10 AND uniques * 100.0 / total <= 0.1 THEN CASE WHEN uniques <= 5 THEN 'high' ELSE 'medium' END END AS confidence
FROM (SELECT *, pipes * 100.0 / total AS p FROM (SELECT question_id, count(*) AS total, count(*) FILTER (WHERE contains(text, '|')) AS pipes, count(DISTINCT text) AS uniques FROM {ANSWERS} WHERE trim(text) <> '' GROUP BY 1))""")
def question_type_inference(spark, d):
    return choices.infer_types(answers(spark, d), min_answers=10, min_percentage=5, scale=0.001)


@query(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY count DESC, text) AS rank FROM (SELECT question_id, text, count(*) AS count FROM {ANSWERS} WHERE trim(text) <> '' GROUP BY 1, 2)) WHERE rank <= 15""")
def top_answers_per_question(spark, d):
    return choices.top_answers(answers(spark, d))


@query("""WITH c AS (SELECT c_mktsegment AS text, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT 900000 + 1 * 100 + row_number() OVER (ORDER BY n DESC, text) AS option_id, text FROM c)
SELECT c_custkey AS answer_id, option_id FROM customer JOIN o ON o.text = c_mktsegment""")
def choice_fix_links(spark, d):
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("question_id"), F.col("c_mktsegment").alias("text"))
    _, links, _ = choices.fix_choice(own, spark.createDataFrame([(1,)], "id int"))
    return links


# ---- counts and pages


@query("SELECT count(*) AS valid_count FROM documents WHERE length(trim(text)) >= 60")
def valid_answer_count(spark, d):
    return rollups.valid_answer_count(answers(spark, d))


@query("SELECT n_nationkey AS question_id, count(c_custkey) AS answers_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def answers_per_question(spark, d):
    return rollups.counts_over(read(spark, d, "nation").select(F.col("n_nationkey").alias("question_id")), "question_id", read(spark, d, "customer"), "c_nationkey", "answers_count")


@query("SELECT r_regionkey AS id, r_name AS name, CAST(count(n_nationkey) AS INT) AS questions_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def forms_with_question_counts(spark, d):
    forms = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return rollups.counts_over(forms, "id", read(spark, d, "nation"), "n_regionkey", "questions_count").withColumn("questions_count", F.col("questions_count").cast("int"))


@query("SELECT c_custkey AS author_id, c_name AS name, count(o_orderkey) AS answers_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def author_answer_counts(spark, d):
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"))
    return rollups.counts_over(people, "author_id", read(spark, d, "orders"), "o_custkey", "answers_count")


@query("""SELECT o_orderkey AS id, o_orderpriority AS form_id, k, total FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate ASC NULLS LAST, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders) WHERE k = greatest(1, least(7, total))""")
def kth_contribution(spark, d):
    order = [F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")]
    return rollups.kth(read(spark, d, "orders"), "o_orderpriority", order, 7).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("form_id"), "k", "total")


@query("""WITH q AS (SELECT DISTINCT role, turn FROM conversations) SELECT q.role, q.turn, c.text FROM q LEFT JOIN (SELECT * FROM conversations WHERE conv_id = 1) c ON c.role = q.role AND c.turn = q.turn""")
def contribution_with_all_questions(spark, d):
    turns = read(spark, d, "conversations")
    asked = turns.select("role", "turn").distinct().select(F.xxhash64("role", "turn").alias("id"), "role", "turn", F.lit(None).cast("int").alias("position"))
    own = turns.where("conv_id = 1").select(F.xxhash64("role", "turn").alias("question_id"), "text")
    return rollups.contribution_view(asked, own).select("role", "turn", "text")


TIMELINE = f"SELECT id, question_id, type, text FROM {ANSWERS} WHERE length(trim(text)) >= 40 AND type NOT IN ('fr')"


def _timeline(spark, d):
    rows = answers(spark, d)
    return rows.where(text.valid_text("text", text.MIN_TIMELINE) & ~F.col("type").isin("fr"))


@query(f"{TIMELINE} ORDER BY id DESC LIMIT 20")
def timeline_page(spark, d):
    return paging.page(_timeline(spark, d), [("id", "desc")])


@query(f"WITH p AS ({TIMELINE} ORDER BY id DESC LIMIT 20) {TIMELINE} AND id < (SELECT min(id) FROM p) ORDER BY id DESC LIMIT 20")
def timeline_page2(spark, d):
    keys = [("id", "desc")]
    _, _, cursor = paging.paginate(_timeline(spark, d).select("id"), keys)
    return paging.page(_timeline(spark, d), keys, paging.decode_cursor(cursor))


@query("""SELECT o_orderkey AS id, o_orderdate AS submitted_at, c_name AS author FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name ILIKE '%1%' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC LIMIT 20 OFFSET 20""")
def question_answers_page(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where(F.col("c_name").ilike("%1%")).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("submitted_at"), F.col("c_name").alias("author"))
    keys = [("submitted_at", "desc"), ("id", "desc")]
    last = paging.page(rows.select("submitted_at", "id"), keys).collect()[-1].asDict()
    return paging.page(rows, keys, last)


@query("""SELECT o_orderkey AS id, o_orderdate AS submitted_at FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC LIMIT 5 OFFSET 5""")
def author_page_offset(spark, d):
    orders = read(spark, d, "orders")
    busiest = orders.groupBy("o_custkey").count().orderBy(F.desc("count"), "o_custkey").limit(1).select("o_custkey")
    own = orders.join(busiest, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("submitted_at"))
    return paging.offset_page(own, [("submitted_at", "desc"), ("id", "desc")], 2, 5)


@query("SELECT o_custkey AS author_id, count(*) AS answers_count, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS total_pages FROM orders GROUP BY 1")
def author_total_pages(spark, d):
    counts = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("author_id")).agg(F.count("*").alias("answers_count"))
    return counts.withColumn("total_pages", paging.total_pages(F.col("answers_count")))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join_unanswered(spark, d):
    own = read(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("answer_id"))
    return choices.unlinked(read(spark, d, "customer").select(F.col("c_custkey").alias("id")), own)


@query("""SELECT c_custkey AS id, c_name AS name, max(l_shipdate) AS lastmod FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 ORDER BY lastmod DESC NULLS LAST, id DESC LIMIT 1000""")
def sitemap_lastmod_authors(spark, d):
    facts = read(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rollups.lastmod(read(spark, d, "customer"), "c_custkey", "c_name", facts, "o_custkey", "l_shipdate", 1000)


SLUG = "CASE WHEN s = '' THEN 'contenu' WHEN length(s) > 60 THEN rtrim(left(s, 60), '-') ELSE s END"


@query(rf"""WITH a AS (SELECT c_custkey AS id, c_name AS name, max(o_orderdate) AS lastmod FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY lastmod DESC NULLS LAST, id DESC LIMIT 50),
f AS (SELECT r_regionkey AS id, r_name AS name, NULL::TIMESTAMP AS lastmod FROM region),
u AS (SELECT '/authors' AS p, * FROM a UNION ALL SELECT '/forms' AS p, * FROM f),
s AS (SELECT *, trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9\s-]', ' ', 'g'), '[-\s]+', '-', 'g'), '-') AS s FROM u)
SELECT 'https://survey.example' || p || '/' || id || '-' || {SLUG} AS loc, strftime(lastmod, '%Y-%m-%dT%H:%M:%SZ') AS lastmod FROM s
UNION ALL SELECT 'https://survey.example' || unnest(['/', '/search']), NULL""")
def sitemap_union(spark, d):
    people = rollups.lastmod(read(spark, d, "customer"), "c_custkey", "c_name", read(spark, d, "orders"), "o_custkey", "o_orderdate", 50)
    forms = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("timestamp_ntz").alias("lastmod"))
    return rollups.site_map("https://survey.example", ["/", "/search"], [("/authors", people), ("/forms", forms)])


@query("""SELECT 'orders' AS name, count(*) AS rows, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders UNION ALL SELECT 'customer', count(*), NULL, NULL FROM customer UNION ALL SELECT 'nation', count(*), NULL, NULL FROM nation""")
def load_report(spark, d):
    return rollups.load_report({n: read(spark, d, n) for n in ("orders", "customer", "nation")}, ("orders", "o_orderdate"))


# ---- search


def indexed(spark, d, analyzer=analyzers.simple_tokens) -> index.Index:
    return index.index_of(read(spark, d, "documents"), "text", "doc_id", analyzer)


@query(rf"SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'thtion'])")
def fts_plain_and(spark, d):
    return index.matches(indexed(spark, d), lambda t: match.plain_query(t, "Thé thtion")).select(F.col("key").alias("doc_id"))


@query(rf"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of the ')")
def fts_phrase(spark, d):
    return index.matches(indexed(spark, d), lambda t: match.expression_query(t, '"of the"')).select(F.col("key").alias("doc_id"))


@query(rf"""SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE (list_contains(t, 'ouvi') AND NOT list_contains(t, 'est')) OR (contains(' ' || array_to_string(t, ' ') || ' ', ' and the ') AND list_contains(t, 'with'))""")
def fts_websearch(spark, d):
    return index.matches(indexed(spark, d), lambda t: match.web_query(t, 'ouvi -est or "and the" with')).select(F.col("key").alias("doc_id"))


@query(rf"SELECT doc_id FROM documents WHERE NOT list_contains({TOKENS}, 'the')")
def fts_without(spark, d):
    return index.matches(indexed(spark, d), lambda t: match.web_query(t, "-the")).select(F.col("key").alias("doc_id"))


KEYWORDS = {"article": "the OR la OR der", "both": "the AND of", "prefix": "thti*", "nested": '("of the" OR "in the") AND th*', "without": "the NOT of"}
KEYWORDS_SQL = rf"""WITH a AS (SELECT {TOKENS} AS t, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS l FROM documents)
SELECT 'article' AS keyword, count(*) FILTER (WHERE list_has_any(t, ['the', 'la', 'der'])) AS count FROM a
UNION ALL SELECT 'both', count(*) FILTER (WHERE list_has_all(t, ['the', 'of'])) FROM a
UNION ALL SELECT 'prefix', count(*) FILTER (WHERE contains(l, ' thti')) FROM a
UNION ALL SELECT 'nested', count(*) FILTER (WHERE (contains(l, ' of the ') OR contains(l, ' in the ')) AND contains(l, ' th')) FROM a
UNION ALL SELECT 'without', count(*) FILTER (WHERE list_contains(t, 'the') AND NOT list_contains(t, 'of')) FROM a"""


@query(KEYWORDS_SQL)
def fts_keyword_counts(spark, d):
    return index.indexed_counts(indexed(spark, d), {k: (lambda t, e=e: match.expression_query(t, e)) for k, e in KEYWORDS.items()})


@query(KEYWORDS_SQL)
def fts_keyword_counts_unindexed(spark, d):
    return search.keyword_counts(search.with_terms(answers(spark, d)), KEYWORDS)


def _bm25_sql(words: list[str], limit: int, sign: str = "") -> str:
    tf = lambda w: f"len(list_filter(t, lambda x: x = '{w}'))"
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * {tf(w)} * 2.2 / ({tf(w)} + 1.2 * (0.25 + 0.75 * len(t) / mean))" for i, w in enumerate(words))
    stats = ", ".join(f"count(*) FILTER (WHERE list_contains(t, '{w}')) AS d{i}" for i, w in enumerate(words))
    return f"""WITH a AS (SELECT doc_id, {TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean, {stats} FROM a)
SELECT doc_id, {sign}round({score}, 6) AS score FROM a, s WHERE list_has_any(t, {words}) ORDER BY score {"ASC" if sign else "DESC"}, doc_id DESC LIMIT {limit}"""


@query(_bm25_sql(["la", "with", "ciudad"], 50))
def fts_bm25(spark, d):
    rows = index.indexed_bm25(indexed(spark, d), "La with ciudad")
    return rows.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), F.desc("doc_id")).limit(50)


@query(_bm25_sql(["of", "des"], 20, "-"))
def fts_bm25_ascending(spark, d):
    """The store's own form: lower is better."""
    rows = index.indexed_bm25(indexed(spark, d), "of des")
    return rows.select(F.col("key").alias("doc_id"), (-F.round("score", 6)).alias("score")).orderBy("score", F.desc("doc_id")).limit(20)


@query(_bm25_sql(["la", "with", "ciudad"], 50))
def fts_bm25_unindexed(spark, d):
    rows = search.bm25(search.with_terms(answers(spark, d)), "La with ciudad")
    return rows.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), F.desc("doc_id")).limit(50)


@query()
def fts_stemmed(spark, d):
    return index.matches(indexed(spark, d, analyzers.analyze_fr), lambda t: match.web_query(t, "mentions ouvi or tionale", analyzers.query_stems)).select(F.col("key").alias("doc_id"))


@query("""SELECT doc_id, regexp_replace(text, '(?i)(^|[^\\p{L}\\p{N}_])((?:tion|ou)[\\p{L}\\p{N}_]*)', '\\1<mark>\\2</mark>', 'g') AS marked FROM documents""")
def headline(spark, d):
    return read(spark, d, "documents").select("doc_id", highlight.headline("text", ["tion", "ou"]).alias("marked"))


@query()
def highlight_page(spark, d):
    """The page's keys come from the index; then its texts alone are read."""
    held = indexed(spark, d)
    long = held.docs.where(F.col("chars") >= text.MIN_SEARCH).select("key")
    hits = index.matches(held, lambda t: match.web_query(t, "the tion")).join(long, "key", "left_semi").select(F.col("key").alias("id"))
    ids = [r["id"] for r in paging.page(hits, [("id", "desc")]).collect()]
    shown = answers(spark, d).where(F.col("id").isin(*ids) if ids else F.lit(False))
    return shown.select("id", highlight.highlight_udf(F.col("text"), F.lit("the tion")).alias("marked"))


def survey(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Answers, questions, contributions and authors: a document is an answer and a contribution of its own."""
    docs = read(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("question_id"), F.col("doc_id").alias("contribution_id"), "text")
    asked = docs.select(F.col("source").alias("id"), F.col("source").alias("prompt"), F.lit("text").alias("type")).distinct()
    given = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("author_id"), F.lit(None).cast("timestamp_ntz").alias("submitted_at"))
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"))
    return rows, asked, given, people


SHOWN = ("answer_id", "question_id", "question_prompt", "author_id", "author_name", "answer_text")
PAGE = "doc_id AS answer_id, source AS question_id, source AS question_prompt, doc_id AS author_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE 'Auteur #' || doc_id END AS author_name, left(text, 20000) AS answer_text FROM documents LEFT JOIN customer ON c_custkey = doc_id"


@query(f"""SELECT {PAGE} WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(trim(text)) >= 60 AND list_contains({TOKENS}, 'the') ORDER BY doc_id DESC LIMIT 1789) ORDER BY doc_id DESC LIMIT 20""")
def search_page(spark, d):
    return search.search_answers(*survey(spark, d), "the", index=indexed(spark, d)).select(*SHOWN)


@query(f"""WITH m AS (SELECT doc_id FROM documents WHERE length(trim(text)) >= 60 AND list_contains({TOKENS}, 'the') ORDER BY doc_id DESC LIMIT 30) SELECT {PAGE} WHERE doc_id IN (SELECT doc_id FROM m ORDER BY doc_id DESC OFFSET 20) ORDER BY doc_id DESC""")
def search_page_last(spark, d):
    """The newest matches end where their limit is, page or not."""
    rows = survey(spark, d)
    first = search.search_answers(*rows, "the", index=indexed(spark, d), newest=30).select("answer_id").collect()
    return search.search_answers(*rows, "the", {"id": first[-1][0]} if first else None, newest=30, index=indexed(spark, d)).select(*SHOWN)


@query(f"""SELECT {PAGE} WHERE length(trim(text)) >= 60 AND list_contains({TOKENS}, 'the') ORDER BY doc_id DESC LIMIT 20""")
def search_page_unindexed(spark, d):
    rows, *others = survey(spark, d)
    return search.search_answers(search.with_terms(rows), *others, "the").select(*SHOWN)


@query(f"""SELECT {PAGE} WHERE length(trim(text)) >= 40 ORDER BY doc_id DESC LIMIT 20""")
def timeline_answers(spark, d):
    """Less than two characters to search for: the timeline."""
    return search.search_answers(*survey(spark, d), " t ").select(*SHOWN)


# ---- text scalars


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def unaccent(spark, d):
    return read(spark, d, "documents").select("doc_id", text.unaccent("text").alias("plain"))


@query(rf"""SELECT doc_id, {SLUG} AS slug FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9\s-]', ' ', 'g'), '[-\s]+', '-', 'g'), '-') AS s FROM documents)""")
def slugify(spark, d):
    return read(spark, d, "documents").select("doc_id", text.slugify("text").alias("slug"))


@query(r"""WITH a AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t FROM pages), b AS (SELECT page_id, t, left(t, 300) AS h FROM a),
c AS (SELECT *, 300 - CASE WHEN regexp_matches(h, '[.!?]') THEN strpos(regexp_replace(reverse(h), '[!?]', '.', 'g'), '.') END AS s, strpos(reverse(h), ' ') AS b FROM b)
SELECT page_id, CASE WHEN length(t) <= 300 THEN t WHEN s > 210 THEN left(h, s + 1) WHEN b > 0 AND b < 300 THEN left(h, 300 - b) || '…' ELSE h || '…' END AS excerpt FROM c""")
def html_excerpt(spark, d):
    return read(spark, d, "pages").select("page_id", text.clean_excerpt("html").alias("excerpt"))


@query(r"""SELECT doc_id, regexp_replace(text, '^[ \-–—:]+', '') AS body FROM documents""")
def strip_boilerplate(spark, d):
    return read(spark, d, "documents").select("doc_id", text.strip_boilerplate(F.concat(F.lit(" Titre : objet: "), F.col("text"))).alias("body"))


@query("""SELECT c_custkey AS id, CASE WHEN length(regexp_replace(c_name, '[^0-9]', '', 'g')) >= 5 THEN left(regexp_replace(c_name, '[^0-9]', '', 'g'), 5) END AS zip, c_nationkey > 0 AS yes, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2019-01-22 09:37:11' END AS at FROM customer""")
def clean_fields(spark, d):
    when = F.when(F.col("c_custkey") % 2 == 0, "2019-01-22 09:37:11").otherwise("KO")
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.clean_zipcode("c_name").alias("zip"), text.truthy(F.col("c_nationkey").cast("string")).alias("yes"), text.parse_datetime(when).alias("at"))


@query("""SELECT DISTINCT sha256('{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","city":null}') AS raw_hash FROM customer""")
def row_hash(spark, d):
    return read(spark, d, "customer").select("c_name", F.lit(None).cast("string").alias("city"), "c_mktsegment").select(text.row_hash(["c_name", "city", "c_mktsegment"]).alias("raw_hash")).distinct()


@query("""SELECT event_type AS query_text, CAST(count(*) AS INT) AS search_count, max(ts) AS last_searched, CASE WHEN count(*) >= 1000 THEN 60 WHEN count(*) >= 100 THEN 45 WHEN count(*) >= 20 THEN 30 WHEN count(*) >= 5 THEN 15 ELSE 5 END AS ttl, 'search:fts:' || event_type || ':' || count(*) AS key FROM events GROUP BY 1""")
def popularity_ttl(spark, d):
    events = read(spark, d, "events").select(F.concat(F.lit(" "), F.upper("event_type")).alias("query"), "ts")
    out = caches.popularity(events)
    return out.withColumn("ttl", text.ttl_minutes("search_count")).withColumn("key", text.cache_key("query_text", F.col("search_count").cast("string")))


@query("""SELECT doc_id, CASE WHEN length(text) > 49 THEN left(text, 48) || '…' ELSE text END || ' - Civic answers' AS title, CASE WHEN length(t) > 160 THEN left(t, 159) || '…' ELSE t END AS description FROM (SELECT *, trim(translate(regexp_replace(text, '<[^>]+>', '', 'g'), chr(10) || chr(13), '  ')) AS t FROM documents)""")
def meta_tags(spark, d):
    return read(spark, d, "documents").select("doc_id", text.meta_title("text", " - Civic answers").alias("title"), text.meta_description("text").alias("description"))


# ---- reshaping and merging


@query("""SELECT p_partkey AS contribution_id, question, answer, row_number() OVER (PARTITION BY p_partkey ORDER BY n) AS position FROM (SELECT p_partkey, unnest(['name', 'brand', 'type']) AS question, unnest([p_name, p_brand, p_type]) AS answer, unnest([1, 2, 3]) AS n FROM part) WHERE trim(answer) <> ''""")
def unpivot_answers(spark, d):
    return ingest.unpivot(read(spark, d, "part").withColumnRenamed("p_partkey", "contribution_id"), "contribution_id", {"p_name": "name", "p_brand": "brand", "p_type": "type"})


@query("SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_wins_upsert(spark, d):
    events = read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return caches.latest_wins(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query("""WITH RECURSIVE o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS i FROM conversations WHERE text IS NOT NULL),
m AS (SELECT conv_id, role, i, text FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.role, o.i, CASE WHEN m.text = '' THEN o.text WHEN contains(m.text, o.text) THEN m.text ELSE m.text || chr(10) || chr(10) || o.text END FROM m JOIN o ON o.conv_id = m.conv_id AND o.role = m.role AND o.i = m.i + 1)
SELECT conv_id, role, arg_max(text, i) AS text FROM m GROUP BY 1, 2""")
def text_merge_answers(spark, d):
    return ingest.merged_texts(read(spark, d, "conversations").where("text IS NOT NULL"), ["conv_id", "role"], "text", [F.col("turn")])


@query("SELECT event_type AS question_id, greatest(0, 100 + sum(CASE WHEN value > 50 THEN 1 ELSE -1 END))::BIGINT AS answers_count FROM events GROUP BY 1")
def counter_merge(spark, d):
    events = read(spark, d, "events")
    old = events.select(F.col("event_type").alias("question_id"), F.lit(100).cast("long").alias("answers_count")).distinct()
    delta = events.groupBy(F.col("event_type").alias("question_id")).agg(F.sum(F.when(F.col("value") > 50, 1).otherwise(-1)).alias("delta"))
    return caches.merge_counts(old, delta, "question_id")


# ---- caches and logs


@query("SELECT count(*) AS entries, CAST(sum(length(props)) AS BIGINT) AS total_size, avg(length(props)) AS mean_size, min(ts) AS oldest, max(ts) AS newest FROM events")
def cache_stats(spark, d):
    return caches.cache_summary(read(spark, d, "events"), "props", "ts")


@query("SELECT event_id, length(props) AS size, ts AS updated, date_diff('second', date_trunc('second', ts), TIMESTAMP '2030-01-01') / 60 AS age_minutes FROM events WHERE ts > (SELECT max(ts) - INTERVAL 48 HOUR FROM events)")
def cache_ages(spark, d):
    events = read(spark, d, "events")
    newest = events.agg(F.max("ts")).first()[0]
    alive = caches.expire(events, F.lit(newest), 48 * 60, "ts")
    return caches.ages(alive, "event_id", "props", "ts", F.lit("2030-01-01").cast("timestamp_ntz"))


@query("SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS requests, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1")
def hourly_requests(spark, d):
    return logs.hourly(read(spark, d, "events"), "ts", "user_id")


@query("SELECT user_id AS ip, count(*) AS requests FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_ips(spark, d):
    return logs.top(read(spark, d, "events"), F.col("user_id"), "ip")


@query("SELECT event_type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 5")
def error_samples(spark, d):
    return logs.samples(read(spark, d, "events"), "event_type", [F.col("ts"), F.col("event_id")]).select("event_type", "event_id", "rank")


# ---- themes


SENTENCES = r"""SELECT doc_id, s AS sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sent_idx FROM (SELECT doc_id, trim(unnest(p)) AS s, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)) WHERE s <> ''"""


@query(rf"""SELECT doc_id, CAST(sent_idx AS INT) AS sent_idx, sentence, prev, next FROM (SELECT *, lag(sentence, 1, '') OVER w AS prev, lead(sentence, 1, '') OVER w AS next FROM ({SENTENCES}) WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)) WHERE contains(lower(sentence), 'ouvi')""")
def sentence_context(spark, d):
    rows = themes.sentences(read(spark, d, "documents"), "doc_id")
    return themes.snippets(rows, "doc_id", ["ouvi"])


@query("""SELECT source AS theme, count(*) FILTER (WHERE quality = 0) AS "0", count(*) FILTER (WHERE quality = 1) AS "1" FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def theme_sentiment_crosstab(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("source").alias("theme")).join(read(spark, d, "labels"), "doc_id")
    return themes.crosstab(rows, "theme", "quality", [0, 1])


@query(r"""SELECT lang, word, count(*) AS count FROM (SELECT lang, unnest(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'http\S+', ' ', 'g'), '[^a-zàâçéèêëîïôûùüÿñæœ\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS word FROM documents) WHERE length(word) > 2 AND word NOT IN ('the', 'les') GROUP BY 1, 2""")
def token_frequencies(spark, d):
    return themes.word_counts(read(spark, d, "documents"), "lang", stops=["the", "les"])


@query()
def tfidf_kmeans_terms(spark, d):
    rows, vocabulary = themes.themes(read(spark, d, "documents").select("doc_id", "text"))
    return themes.theme_terms(rows, vocabulary)
