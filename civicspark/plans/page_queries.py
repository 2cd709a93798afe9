"""More queries: single pages and dashboards, ingest, logs, files in and out, caches and text scalars. Roles as in `catalog`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import highlight, text
from ..operators import caches, choices, ingest, logs, pages, rollups, search, themes
from ..sources import files
from ..storage import shared_dir
from .catalog import ANSWERS, SLUG, TOKENS, options, pct, picks, query, read

# ---- single pages


@query("SELECT * FROM customer WHERE c_custkey = 77")
def point_lookup(spark, d):
    return pages.by_id(read(spark, d, "customer"), 77, "c_custkey")


@query("SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('F')")
def in_lists(spark, d):
    return read(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & ~F.col("o_orderstatus").isin("F")).select(F.col("o_orderkey").alias("id"), "o_orderpriority")


def _orders(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Line items as answers, orders as contributions, parts as questions, customers as authors."""
    items = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("contribution_id"), F.col("l_partkey").alias("question_id"), F.concat_ws(" ", F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus").alias("text"))
    given = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("form_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("submitted_at"))
    asked = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"))
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return items, given, asked, people


ITEMS = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS contribution_id, l_partkey AS question_id, 'flag ' || l_returnflag || ' status ' || l_linestatus AS text FROM lineitem)"


def slug_sql(column: str) -> str:
    return rf"(SELECT {SLUG} FROM (SELECT trim(regexp_replace(regexp_replace(lower(strip_accents({column})), '[^a-z0-9\s-]', ' ', 'g'), '[-\s]+', '-', 'g'), '-') AS s))"


@query(f"""SELECT a.id AS answer_id, a.text AS answer_text, a.question_id, p_name AS question_prompt, {slug_sql('p_name')} AS question_slug, o_custkey AS author_id, c_name AS author_name, {slug_sql('c_name')} AS author_slug, o_orderdate AS submitted_at
FROM {ITEMS} a JOIN orders ON o_orderkey = contribution_id JOIN part ON p_partkey = question_id LEFT JOIN customer ON c_custkey = o_custkey WHERE a.id = (SELECT min(l_orderkey * 10 + l_linenumber) FROM lineitem)""")
def answer_page(spark, d):
    answers, given, asked, people = _orders(spark, d)
    one = read(spark, d, "lineitem").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).first()[0]
    return pages.answer_page(answers, given, asked, people, one)


@query(f"SELECT question_id, count(*) AS total FROM {ANSWERS} WHERE length(trim(text)) >= 60 AND text ILIKE '%THE%' GROUP BY 1")
def question_totals(spark, d):
    return pages.question_totals(read(spark, d, "documents").select(F.col("source").alias("question_id"), "text"), "THE")


@query(f"SELECT question_id, count(*) AS total FROM {ANSWERS} WHERE length(trim(text)) >= 60 GROUP BY 1")
def question_totals_all(spark, d):
    return pages.question_totals(read(spark, d, "documents").select(F.col("source").alias("question_id"), "text"))


@query("""WITH a AS (SELECT doc_id AS id, source AS question_id, o_custkey AS author_id, o_orderdate AS submitted_at, text FROM documents JOIN orders ON o_orderkey = doc_id WHERE source = (SELECT min(source) FROM documents) AND length(trim(text)) >= 60 AND text ILIKE '%on%')
SELECT *, (SELECT count(*) FROM a) AS total FROM a ORDER BY submitted_at DESC NULLS FIRST, id DESC LIMIT 20""")
def question_page(spark, d):
    docs = read(spark, d, "documents")
    given = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("submitted_at"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("contribution_id"), F.col("source").alias("question_id"), "text")
    return pages.question_page(rows, given, docs.agg(F.min("source")).first()[0], "on")


@query("""WITH c AS (SELECT * FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate ASC NULLS LAST, o_orderkey) AS k FROM orders WHERE o_orderpriority = '2-HIGH') WHERE k = 3)
SELECT q.turn AS id, CAST(q.turn AS INT) AS position, a.l_returnflag AS text FROM (SELECT DISTINCT turn FROM conversations) q LEFT JOIN (SELECT l_linenumber, l_returnflag FROM lineitem JOIN c ON l_orderkey = c.o_orderkey) a ON a.l_linenumber = q.turn""")
def form_page(spark, d):
    asked = read(spark, d, "conversations").select(F.col("turn").alias("id"), F.lit("2-HIGH").alias("form_id"), F.col("turn").cast("int").alias("position")).distinct()
    given = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("contribution_id"), F.col("l_linenumber").alias("question_id"), F.col("l_returnflag").alias("text"))
    return pages.form_page(asked, _orders(spark, d)[1], given, "2-HIGH", 3).select("id", "position", "text")


@query("SELECT p_partkey AS id, p_name AS name, max(l_shipdate) AS lastmod FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY 3 DESC NULLS LAST, 1 DESC LIMIT 2000")
def sitemap_lastmod_questions(spark, d):
    return rollups.lastmod(read(spark, d, "part"), "p_partkey", "p_name", read(spark, d, "lineitem"), "l_partkey", "l_shipdate", 2000)


# ---- forms' and questions' search


def _score_sql(tokens: str, words: list[str]) -> str:
    tf = lambda w: f"len(list_filter({tokens}, lambda x: x = '{w}'))"
    return " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * {tf(w)} * 2.2 / ({tf(w)} + 1.2 * (0.25 + 0.75 * len({tokens}) / mean))" for i, w in enumerate(words))


FORMS = f"""WITH a AS (SELECT p_partkey AS id, p_name AS name, {TOKENS.replace('text', 'p_name')} AS t FROM part), s AS (SELECT count(*) AS n, avg(len(t)) AS mean, count(*) FILTER (WHERE list_contains(t, 'red')) AS d0 FROM a),
r AS (SELECT id, name, round({_score_sql('t', ['red'])}, 6) AS score FROM a, s WHERE list_contains(t, 'red'))
SELECT id, name, CAST((SELECT count(*) FROM lineitem WHERE l_partkey = id) AS INT) AS questions_count, {slug_sql('name')} AS slug, score FROM r ORDER BY score DESC, id DESC LIMIT 20"""


def _forms(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), read(spark, d, "lineitem").select(F.col("l_partkey").alias("form_id"))


@query(FORMS)
def form_search(spark, d):
    return search.search_forms(*_forms(spark, d), "Red")


@query(f"SELECT p_partkey AS id, p_name AS name, CAST((SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS INT) AS questions_count, {slug_sql('p_name')} AS slug, 0.0::DOUBLE AS score FROM part WHERE p_partkey < 150 ORDER BY p_partkey DESC LIMIT 20")
def form_browse(spark, d):
    return search.search_forms(*_forms(spark, d), last={"score": 0.0, "id": 150})


HIT = r"regexp_matches(regexp_replace(strip_accents(lower(x)), '[^\p{L}\p{N}]', '', 'g'), '^(the|of)')"
MARKED = f"""array_to_string(list_transform(list_slice(w, b, b + 17), lambda x: CASE WHEN {HIT} THEN '<mark>' || x || '</mark>' ELSE x END), ' ')"""
QUESTIONS = f"""WITH a AS (SELECT conv_id * 100 + turn AS id, role AS question_code, text AS prompt, 'text' AS type, {TOKENS} AS t, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM conversations),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean, count(*) FILTER (WHERE list_contains(t, 'the')) AS d0, count(*) FILTER (WHERE list_contains(t, 'of')) AS d1 FROM a),
r AS (SELECT *, round({_score_sql('t', ['the', 'of'])}, 6) AS score FROM a, s WHERE list_has_all(t, ['the', 'of'])),
f AS (SELECT *, greatest(1, least(greatest(1, coalesce(list_position(list_transform(w, lambda x: {HIT}), true), 1)) - 9, len(w) - 17)) AS b FROM r)
SELECT id, question_code, prompt AS title, type, CAST(coalesce((SELECT count(*) FROM lineitem WHERE l_orderkey = id), 0) AS INT) AS answers_count, {MARKED} AS prompt_hl, {slug_sql('prompt')} AS slug, score FROM f ORDER BY score DESC, id DESC LIMIT 20"""


def _questions(spark, d):
    asked = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("question_code"), F.col("text").alias("prompt"), F.lit("text").alias("type"))
    return asked, read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(F.count("*").alias("answers_count"))


@query(QUESTIONS)
def question_search(spark, d):
    return search.search_questions(*_questions(spark, d), "the of")


@query(f"{QUESTIONS} OFFSET 20")
def question_search_page2(spark, d):
    """The second page, by the score and id of the first one's last row."""
    rows = _questions(spark, d)
    last = search.search_questions(*rows, "the of").select("score", "id").collect()
    return search.search_questions(*rows, "the of", last[-1].asDict() if last else None)


# ---- dashboards


def _choices(spark, d):
    """Regions as single-choice questions with nations as options, and languages as multiple-choice ones over their documents."""
    single = read(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.lit(1).alias("form_id"), F.col("r_name").alias("prompt"), F.lit("single_choice").alias("type"), F.col("r_regionkey").cast("int").alias("position"))
    many = read(spark, d, "documents").select(F.col("lang").alias("id"), F.lit(1).alias("form_id"), F.concat(F.lit("Which of these parts, as they stand between the bars, are found in texts in the language "), "lang").alias("prompt"), F.lit("multi_choice").alias("type"), F.lit(None).cast("int").alias("position")).distinct()
    own = options(spark, d).withColumn("question_id", F.col("question_id").cast("string"))
    return single.unionByName(many), own, picks(spark, d).where("option_id % 5 <> 2"), read(spark, d, "documents").select(F.col("lang").alias("question_id"), "text")


def stats_sql(top: int) -> str:
    return f"""q AS (SELECT r_regionkey::VARCHAR AS id, r_name AS prompt, 'single_choice' AS type, r_regionkey::INT AS position FROM region UNION ALL SELECT DISTINCT lang, 'Which of these parts, as they stand between the bars, are found in texts in the language ' || lang, 'multi_choice', NULL::INT FROM documents),
o AS (SELECT n_regionkey::VARCHAR AS question_id, n_nationkey AS option_id, n_name AS label, count(c_custkey) AS count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 2 GROUP BY ALL),
s AS (SELECT question_id, place, label, count, coalesce({pct('count', 'nullif(total, 0)')}, 0.0) AS percentage FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY option_id) AS place, sum(count) OVER (PARTITION BY question_id) AS total FROM o) WHERE place <= {top}),
p AS (SELECT lang AS question_id, text FROM documents WHERE contains(text, '|')),
n AS (SELECT question_id, count(*) AS responses FROM p GROUP BY 1),
l AS (SELECT question_id, label, count(*) AS count FROM (SELECT question_id, regexp_replace(unnest(string_split(text, '|')), '^\\s+|\\s+$', '', 'g') AS label FROM p) WHERE label <> '' GROUP BY 1, 2),
m AS (SELECT question_id, place, label, count, {pct('count', 'responses')} AS percentage FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY count DESC, label) AS place FROM l) JOIN n USING (question_id) WHERE place <= {top}),
st AS (SELECT * FROM s UNION ALL SELECT * FROM m)"""


SHORT = "CASE WHEN length(label) > 30 THEN left(label, 30) || '...' ELSE label END"


@query(f"""WITH {stats_sql(10)} SELECT question_id, CASE WHEN length(prompt) > 80 THEN left(prompt, 80) || '...' ELSE prompt END AS question_prompt, type, position, sum(count)::BIGINT AS total_answers, string_agg({SHORT} || '=' || count || '=' || percentage, '; ' ORDER BY place) AS shown
FROM st JOIN q ON q.id = question_id GROUP BY 1, 2, 3, 4 HAVING sum(count) > 0""")
def dashboard_stats(spark, d):
    rows = pages.choice_dashboard(*_choices(spark, d))
    shown = F.array_join(F.transform("stats", lambda s: F.concat_ws("=", text.cut(s["label"], 30), s["count"].cast("string"), s["percentage"].cast("string"))), "; ")
    return rows.select("question_id", "question_prompt", "type", "position", "total_answers", shown.alias("shown"))


def _places(spark, d):
    rows = pages.choice_dashboard(*_choices(spark, d)).select("question_id", F.explode("stats").alias("s"))
    return rows.select("question_id", F.col("s.place").alias("place"), F.col("s.label").alias("label"), F.col("s.count").alias("count"))


@query(f"""WITH {stats_sql(10)} SELECT question_id, place::INT AS place, CASE WHEN length(label) > 40 THEN left(label, 40) || '...' ELSE label END AS label, count, width_percent FROM (SELECT *, CASE WHEN max(count) OVER (PARTITION BY question_id) > 0 THEN count / max(count) OVER (PARTITION BY question_id) * 100 ELSE 0 END AS width_percent, sum(count) OVER (PARTITION BY question_id) AS total FROM st) WHERE total > 0 AND place <= 5""")
def chart_bars(spark, d):
    return pages.bar_widths(_places(spark, d))


@query(f"""WITH {stats_sql(10)} SELECT question_id, string_agg(CASE WHEN length(label) > 25 THEN left(label, 25) || '...' ELSE label END, '; ' ORDER BY place) FILTER (WHERE place <= 4) AS labels, greatest(0, count(*) - 4)::INT AS others FROM st GROUP BY 1 HAVING sum(count) > 0""")
def chart_legend(spark, d):
    return pages.legend(_places(spark, d)).withColumn("labels", F.array_join("labels", "; "))


KEY = "left(sha256({}), 16)"


@query(f"SELECT *, {KEY.format('''form_id || chr(31) || form_name || chr(31) || questions_count''')} AS image_key FROM (SELECT r_regionkey AS form_id, r_name AS form_name, count(n_nationkey) AS questions_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2)")
def form_images(spark, d):
    return pages.form_images(read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), read(spark, d, "nation").select(F.col("n_regionkey").alias("form_id")))


@query(f"""WITH {stats_sql(6)}, b AS (SELECT question_id, string_agg(label || '=' || count, '|' ORDER BY place) AS bars FROM st GROUP BY 1 HAVING sum(count) > 0)
SELECT id AS question_id, type AS question_type, answers_count, bars, {KEY.format('''id || chr(31) || prompt || chr(31) || type || chr(31) || answers_count || chr(31) || coalesce(bars, '')''')} AS image_key FROM (SELECT q.*, (SELECT count(*) FROM documents WHERE lang = q.id) AS answers_count FROM q) LEFT JOIN b ON question_id = id""")
def question_images(spark, d):
    return pages.question_images(*_choices(spark, d)).select("question_id", "question_type", "answers_count", F.array_join("bars", "|").alias("bars"), "image_key")


@query("SELECT sum(live)::BIGINT AS live, sum(dead)::BIGINT AS dead, sum(CASE WHEN dead > live THEN 1 ELSE 0 END)::BIGINT AS worn, round(sum(dead)::DECIMAL(20,0) * 100 / greatest(sum(live) + sum(dead), 1)::DECIMAL(20,0), 2)::DOUBLE AS dead_pct FROM (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS live, count(*) FILTER (WHERE l_returnflag = 'R') AS dead FROM lineitem GROUP BY 1)")
def store_health(spark, d):
    tables = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("live"), F.count_if(F.col("l_returnflag") == "R").alias("dead"))
    return pages.health(tables)


TYPES = "SELECT 'flag' AS question_id, l_returnflag AS text FROM lineitem UNION ALL SELECT 'both', l_returnflag || '|' || l_linestatus FROM lineitem UNION ALL SELECT 'some', CASE WHEN l_quantity < 18 THEN l_returnflag || '|' ELSE l_linestatus END FROM lineitem UNION ALL SELECT 'few', CASE WHEN l_quantity < 3 THEN l_returnflag || '|' ELSE l_linestatus END FROM lineitem UNION ALL SELECT 'day', l_shipdate::VARCHAR FROM lineitem UNION ALL SELECT 'blank', ' ' FROM lineitem"


@query(f"""SELECT question_id, total, pipes, uniques, {pct('pipes', 'total')} AS pipe_pct, {pct('uniques', 'total')} AS unique_pct,
  CASE WHEN total >= 100 AND pipes >= 1000 THEN CASE WHEN p >= 40 OR p >= 20 AND pipes >= 10000 OR p >= 30 THEN 'multi_choice' END WHEN pipes >= 500 AND p >= 50 THEN 'multi_choice' WHEN total >= 10000 AND uniques <= 10 AND uniques * 100.0 / total <= 0.1 THEN 'single_choice' END AS suggested,
  CASE WHEN total >= 100 AND pipes >= 1000 THEN CASE WHEN p >= 40 THEN 'high' WHEN p >= 20 AND pipes >= 10000 THEN 'medium' WHEN p >= 30 THEN 'medium' END WHEN pipes >= 500 AND p >= 50 THEN 'medium' WHEN total >= 10000 AND uniques <= 10 AND uniques * 100.0 / total <= 0.1 THEN CASE WHEN uniques <= 5 THEN 'high' ELSE 'medium' END END AS confidence
FROM (SELECT *, pipes * 100.0 / total AS p FROM (SELECT question_id, count(*) AS total, count(*) FILTER (WHERE contains(text, '|')) AS pipes, count(DISTINCT text) AS uniques FROM ({TYPES}) WHERE trim(text) <> '' GROUP BY 1))""")
def question_types(spark, d):
    items = read(spark, d, "lineitem")
    kinds = {
        "flag": F.col("l_returnflag"), "both": F.concat_ws("|", "l_returnflag", "l_linestatus"), "some": F.when(F.col("l_quantity") < 18, F.concat("l_returnflag", F.lit("|"))).otherwise(F.col("l_linestatus")),
        "few": F.when(F.col("l_quantity") < 3, F.concat("l_returnflag", F.lit("|"))).otherwise(F.col("l_linestatus")), "day": F.col("l_shipdate").cast("string"), "blank": F.lit(" "),
    }
    cells = F.array(*(F.struct(F.lit(k).alias("question_id"), v.alias("text")) for k, v in kinds.items()))
    return choices.infer_types(items.select(F.explode(cells).alias("c")).select("c.*"))


# ---- ingest: parts as the rows of a wide file, in the order of their keys

MAPPING = {
    "form": {"name": "Parts", "version": "1", "source": "test"},
    "defaults": {"author": {"source_author_id": "authorId", "zipcode": "authorZip"}, "contribution": {"source_contribution_id": "reference", "title": "title"}},
    "questions": [
        {"code": "kind", "prompt": "Kind", "type": "single_choice", "source_column": "kind", "options_from_values": True, "options": [{"code": "std", "label": "STANDARD"}, {"code": "prm", "label": "PROMO", "position": 7}]},
        {"code": "marks", "prompt": "Marks", "type": "multi_choice", "source_column": "marks", "options_from_values": True},
        {"code": "size", "prompt": "Size", "type": "number", "source_column": "size"},
        {"code": "words", "prompt": "Words", "type": "free_text", "source": {"columns": ["title", "maker"], "joiner": " / "}},
        {"code": "plain", "prompt": "Plain", "type": "text", "source_column": "maker"},
    ],
}
WIDE = """w AS (SELECT ref, p_name, p_brand, p_type, p_size, min(p_partkey) AS seq FROM (SELECT *, (p_partkey % 700)::VARCHAR AS ref FROM part WHERE p_size <> 1 AND p_size <> 2) GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY seq DESC) AS r FROM w) WHERE r = 1)"""


def _wide(spark, d) -> DataFrame:
    size = F.col("p_size")
    return read(spark, d, "part").select(
        (F.col("p_partkey") % 700).cast("string").alias("reference"), F.col("p_name").alias("title"), F.col("p_brand").alias("authorId"), F.col("p_brand").alias("maker"), size.cast("string").alias("authorZip"), size.cast("string").alias("size"),
        F.when(size == 1, " TRUE ").when(size > 9, "0").alias("trashed"), F.when(size == 2, "deleted").when(size > 30, "Kept").otherwise("").alias("trashedStatus"),
        F.col("p_type").alias("kind"), F.concat_ws("; ", "p_type", "p_brand", F.lit(" "), "p_type").alias("marks"), F.col("p_partkey").alias("line"),
    )


def _ingested(spark, d, **more) -> ingest.Survey:
    return ingest.ingest(_wide(spark, d), MAPPING, order="line", **more)


def _coded(survey: ingest.Survey, answers: DataFrame) -> DataFrame:
    """Answers with natural keys."""
    own = survey.contributions.select(F.col("id").alias("contribution_id"), F.col("source_contribution_id").alias("reference"))
    return answers.join(own, "contribution_id").join(survey.questions.select(F.col("id").alias("question_id"), "question_code"), "question_id")


@query(f"WITH {WIDE} SELECT ref AS reference, p_name AS title, p_brand AS author, 'test' AS source FROM k")
def ingest_contributions(spark, d):
    s = _ingested(spark, d)
    return s.contributions.join(s.authors.select(F.col("id").alias("author_id"), F.col("source_author_id").alias("author")), "author_id").select(F.col("source_contribution_id").alias("reference"), "title", "author", "source")


@query(f"WITH {WIDE} SELECT p_brand AS source_author_id, arg_min(p_size, seq)::VARCHAR AS zipcode FROM w GROUP BY 1")
def ingest_authors(spark, d):
    return _ingested(spark, d).authors.select("source_author_id", "zipcode")


@query(f"""WITH {WIDE} SELECT ref AS reference, 'kind' AS question_code, p_type AS text, NULL AS value_json FROM k UNION ALL SELECT ref, 'marks', NULL, NULL FROM k UNION ALL SELECT ref, 'size', NULL, '{{"value":"' || p_size || '"}}' FROM k
UNION ALL SELECT ref, 'words', p_name || ' / ' || p_brand, NULL FROM k UNION ALL SELECT ref, 'plain', p_brand, NULL FROM k""")
def ingest_answers(spark, d):
    s = _ingested(spark, d)
    return _coded(s, s.answers).select("reference", "question_code", "text", "value_json")


CODE = "regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g')"


@query(f"""WITH {WIDE} SELECT DISTINCT ref AS reference, 'kind' AS question_code, CASE p_type WHEN 'STANDARD' THEN 'std' WHEN 'PROMO' THEN 'prm' ELSE {CODE.format('p_type')} END AS code FROM k
UNION ALL SELECT DISTINCT ref, 'marks', {CODE.format('unnest([p_type, p_brand])')} FROM k""")
def ingest_links(spark, d):
    s = _ingested(spark, d)
    links = s.answer_options.join(s.options.select(F.col("id").alias("option_id"), "code"), "option_id")
    return _coded(s, s.answers.select(F.col("id").alias("answer_id"), "contribution_id", "question_id").join(links, "answer_id")).select("reference", "question_code", "code")


@query(f"""WITH {WIDE} SELECT 'kind' AS question_code, 'std' AS code, 'STANDARD' AS label, 1 AS position UNION ALL SELECT 'kind', 'prm', 'PROMO', 7
UNION ALL SELECT DISTINCT 'kind', {CODE.format('p_type')}, p_type, NULL::INT FROM k WHERE p_type NOT IN ('STANDARD', 'PROMO') UNION ALL SELECT DISTINCT 'marks', {CODE.format('x')}, x, NULL::INT FROM (SELECT unnest([p_type, p_brand]) AS x FROM k)""")
def ingest_options(spark, d):
    s = _ingested(spark, d)
    return s.options.join(s.questions.select(F.col("id").alias("question_id"), "question_code"), "question_id").select("question_code", "code", "label", "position")


@query(f"""WITH RECURSIVE {WIDE}, o AS (SELECT ref, p_name || ' / ' || p_brand AS text, row_number() OVER (PARTITION BY ref ORDER BY seq) AS i FROM w),
m AS (SELECT ref, i, text FROM o WHERE i = 1 UNION ALL SELECT o.ref, o.i, CASE WHEN contains(m.text, o.text) THEN m.text ELSE m.text || chr(10) || chr(10) || o.text END FROM m JOIN o ON o.ref = m.ref AND o.i = m.i + 1)
SELECT ref AS reference, arg_max(text, i) AS text FROM m GROUP BY 1""")
def ingest_merged_texts(spark, d):
    s = _ingested(spark, d, merge=True)
    return _coded(s, s.answers).where("question_code = 'words'").select("reference", "text")


@query(f"WITH {WIDE} SELECT 'Parts' AS name, '1' AS form_version, 5::BIGINT AS questions, (SELECT count(*) FROM k) AS contributions")
def ingest_forms(spark, d):
    s = _ingested(spark, d)
    forms = rollups.counts_over(rollups.counts_over(s.forms, "id", s.questions, "form_id", "questions"), "id", s.contributions, "form_id", "contributions")
    return forms.select("name", F.col("version").alias("form_version"), "questions", "contributions")


@query("""SELECT coalesce(o.p_partkey, n.p_partkey) AS id, coalesce(o.code, n.code) AS code, coalesce(n.label, o.label) AS label, coalesce(n.position, o.position) AS position
FROM (SELECT p_partkey, 'c' || p_partkey AS code, p_name AS label, p_size AS position FROM part WHERE p_partkey < 150) o FULL JOIN (SELECT p_partkey, 'c' || p_partkey AS code, p_brand AS label, CASE WHEN p_size > 20 THEN p_size + 100 END AS position FROM part WHERE p_partkey BETWEEN 100 AND 199) n USING (code)""")
def option_upsert(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.lit(1).alias("question_id"), F.concat(F.lit("c"), F.col("p_partkey")).alias("code"), "p_name", "p_brand", "p_size")
    old = rows.where("id < 150").select("id", "question_id", "code", F.col("p_name").alias("label"), F.col("p_size").alias("position"))
    new = rows.where("id BETWEEN 100 AND 199").select("id", "question_id", "code", F.col("p_brand").alias("label"), F.when(F.col("p_size") > 20, F.col("p_size") + 100).alias("position"))
    return caches.upsert_options(old, new).select("id", "code", "label", "position")


# ---- caches


def _cache(spark, d) -> DataFrame:
    rows = read(spark, d, "events").select(F.concat(F.lit("k"), F.col("event_id") % 40).alias("cache_key"), F.when(F.col("event_id") % 7 != 0, F.col("props")).otherwise("{broken").alias("results_json"), F.col("ts").alias("created_at"))
    return caches.latest_wins(rows, ["cache_key"], [F.desc("created_at"), F.desc("results_json")])


CACHE = "c AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, results_json DESC) AS r FROM (SELECT 'k' || event_id % 40 AS cache_key, CASE WHEN event_id % 7 <> 0 THEN props ELSE '{broken' END AS results_json, ts AS created_at FROM events)) WHERE r = 1)"


@query(f"WITH {CACHE} SELECT * FROM c WHERE cache_key IN ('k3', 'k4', 'k5', 'k39') AND created_at > (SELECT max(created_at) - INTERVAL 90 MINUTE FROM c) AND json_valid(results_json)")
def cache_get(spark, d):
    cache = _cache(spark, d)
    now = F.lit(cache.agg(F.max("created_at")).first()[0])
    out = [caches.lookup(cache, k, now, 90) for k in ("k3", "k4", "k5", "k39")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(f"WITH {CACHE}, n AS (SELECT 'k' || c_custkey AS cache_key, c_name AS results_json, TIMESTAMP '2031-01-01' AS created_at FROM customer WHERE c_custkey BETWEEN 30 AND 60) SELECT * FROM n UNION ALL SELECT * FROM c WHERE cache_key NOT IN (SELECT cache_key FROM n)")
def cache_put(spark, d):
    new = read(spark, d, "customer").where("c_custkey BETWEEN 30 AND 60").select(F.concat(F.lit("k"), "c_custkey").alias("cache_key"), F.col("c_name").alias("results_json"), F.lit("2031-01-01").cast("timestamp_ntz").alias("created_at"))
    return caches.put(_cache(spark, d), new)


@query("SELECT event_type AS query_text, 2 * count(*)::INT AS search_count, max(ts) AS last_searched FROM events GROUP BY 1")
def popularity_upsert(spark, d):
    events = read(spark, d, "events").select(F.concat(F.upper("event_type"), F.lit("  ")).alias("query"), "ts")
    return caches.add_popularity(caches.popularity(events), events)


@query("""SELECT doc_id, CASE WHEN length(k) > 100 THEN 'search:sha256:' || sha256(k) ELSE k END AS key FROM (SELECT doc_id, CASE WHEN lower(trim(q)) = '' THEN 'search:timeline:' || c WHEN length(trim(q)) >= 2 THEN 'search:fts:' || lower(trim(q)) || ':' || c ELSE 'search:timeline:' || lower(trim(q)) || ':' || c END AS k
FROM (SELECT doc_id, left(text, doc_id % 130) AS q, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS c FROM documents))""")
def cache_keys(spark, d):
    """Beginnings of texts as queries: empty ones, single letters, long ones."""
    rows = read(spark, d, "documents").select("doc_id", F.left("text", (F.col("doc_id") % 130).cast("int")).alias("q"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("c"))
    return rows.select("doc_id", text.cache_key("q", "c").alias("key"))


# ---- logs: a line for each event, all classes among them

REQUESTS = [(404, "GET /favicon.ico"), (404, "GET /wp-login.php"), (404, "GET /answers/9"), (404, "GET /nowhere"), (500, "GET /forms/3/dashboard"), (500, "GET /search/answers"), (500, "GET /"), (408, "POST /search/answers"), (408, "GET /"), (405, "POST /"), (418, "GET /"), (200, "GET /questions/4"), (200, "GET /static/x.css")]
CLASS_NAMES = ["Ressources statiques manquantes", "Tentatives d'intrusion", "Pages de contenu introuvables", "Pages 404 diverses", "Erreurs dashboard formulaires", "Erreurs de recherche", "Erreurs serveur diverses", "Timeouts de recherche", "Timeouts divers", "Méthodes HTTP non autorisées", "Erreurs 418"]


def _lines(spark, d) -> DataFrame:
    which = (F.col("event_id") % len(REQUESTS)).cast("int")
    of = lambda i: F.element_at(F.array(*(F.lit(str(r[i])) for r in REQUESTS)), which + 1)
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".123456789 +0100 CET [web-1] 10.0.0."), F.col("user_id").cast("string"), F.lit(':4711 - "'), of(1), F.lit(' HTTP/1.1" '), of(0))
    return read(spark, d, "events").select(F.when(F.col("event_id") % 97 == 0, "no such line").otherwise(line).alias("value"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


LINES = f"(SELECT ts, user_id, event_id, {[r[0] for r in REQUESTS]}[event_id % {len(REQUESTS)} + 1] AS status, [{', '.join(quoted(r[1]) for r in REQUESTS)}][event_id % {len(REQUESTS)} + 1] AS request FROM events WHERE event_id % 97 <> 0)"


@query(f"SELECT category, count, {pct('count', 'sum(count) OVER ()')} AS percentage FROM (SELECT [{', '.join(map(quoted, CLASS_NAMES))}][event_id % {len(REQUESTS)} + 1] AS category, count(*) AS count FROM {LINES} WHERE status >= 400 GROUP BY 1)")
def error_categories(spark, d):
    rows = logs.parse(_lines(spark, d)).where("status >= 400")
    return logs.shares(rows, logs.error_category(F.col("status"), F.col("request")), "category")


@query(f"SELECT count(*) AS requests, count(DISTINCT user_id) AS visitors, count(*) FILTER (WHERE status = 200 AND request = 'GET /questions/4') AS page_views, count(*) FILTER (WHERE user_id IN (3, 5)) AS bot_requests, count(*) FILTER (WHERE user_id NOT IN (3, 5)) AS human_requests FROM {LINES}")
def visitor_report(spark, d):
    return logs.visitor_report(logs.parse(_lines(spark, d), shape=logs.PAGE_LINE), ["10.0.0.3", "10.0.0.5"])


@query(f"SELECT date_trunc('second', ts) AS ts, '10.0.0.' || user_id AS ip, status::INT AS status, split_part(request, ' ', 1) AS method, split_part(request, ' ', 2) AS path FROM {LINES}")
def log_scan(spark, d):
    """The lines by way of text files."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    _lines(spark, d).write.text(path)
    return logs.parse(files.read_log(spark, path)).select("ts", "ip", "status", "method", "path")


# ---- files out and in again


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'a \"b\";' || chr(10) || 'c' ELSE '' END AS note FROM customer")
def csv_round_trip(spark, d):
    """Exported with quotes and line ends in cells, and read as a survey file with a sniffed delimiter."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    note = F.when(F.col("c_custkey") % 3 == 0, 'a "b";\nc').otherwise(F.lit(" "))
    files.export_csv(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name").alias("name"), note.alias("note")), path)
    return files.read_survey(spark, f"{path}/*.csv")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'a \"b\";' || chr(10) || 'c' ELSE '' END AS note FROM customer")
def csv_split_round_trip(spark, d):
    """As csv_round_trip, read by splits of the files."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    note = F.when(F.col("c_custkey") % 3 == 0, 'a "b";\nc').otherwise(F.lit(" "))
    files.export_csv(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name").alias("name"), note.alias("note")), path)
    return files.read_survey_split(spark, f"{path}/*.csv")


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer")
def json_round_trip(spark, d):
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    files.export_json(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), path)
    return spark.read.schema("id long, name string, nation int").json(path)


@query("SELECT r_regionkey::BIGINT AS id, r_name AS name, '1' AS version, NULL::VARCHAR AS source FROM region")
def bulk_load(spark, d):
    """A bulk file to a table of the model."""
    path = f"{shared_dir(spark)}/bulk-{uuid.uuid4().hex}"
    files.export_csv(read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("version"), F.lit(None).cast("string").alias("source")), f"{path}/forms.csv")
    files.load_all(spark, path, f"{path}/out", ["forms"])
    return spark.read.parquet(f"{path}/out/forms")


@query("SELECT 'https://survey.example/a/' || c_custkey AS loc, CASE WHEN c_custkey % 2 = 0 THEN '2020-01-02T03:04:05Z' END AS lastmod FROM customer")
def site_map_round_trip(spark, d):
    path = f"{shared_dir(spark)}/xml-{uuid.uuid4().hex}"
    urls = read(spark, d, "customer").select(F.concat(F.lit("https://survey.example/a/"), F.col("c_custkey")).alias("loc"), F.when(F.col("c_custkey") % 2 == 0, "2020-01-02T03:04:05Z").alias("lastmod"))
    files.export_site_map(urls, path)
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


# ---- text scalars and themes


@query(r"""SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(trim(t)), '\s+', '-', 'g'), '[^a-z0-9_/-]', '', 'g') AS path_slug, CASE WHEN o = '' THEN 'na' ELSE left(o, 64) END AS option_code, md5(p_brand) AS author, CASE WHEN length(t) > 9 THEN true ELSE false END AS was_cut, left(t, 9) AS snippet
FROM (SELECT *, regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS o FROM (SELECT *, CASE WHEN p_size % 9 = 0 THEN '???' ELSE ' Été ' || p_name || ' / ' || p_type END AS t FROM part))""")
def small_scalars(spark, d):
    t = F.when(F.col("p_size") % 9 == 0, "???").otherwise(F.concat(F.lit(" Été "), "p_name", F.lit(" / "), "p_type"))
    snippet, was_cut = text.clean_snippet(t, 9)
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.path_slug(t).alias("path_slug"), text.option_code(t).alias("option_code"), files.author_hash(F.col("p_brand")).alias("author"), was_cut.alias("was_cut"), snippet.alias("snippet"))


@query("SELECT p_partkey AS id, p_name || ' … ' || p_type || ', x' AS text FROM part")
def snippet_segments(spark, d):
    t = F.concat(F.lit("… "), "p_name", F.lit(" … "), "p_name", F.lit("… …"), "p_type", F.lit("  , x …"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.dedupe_segments(t).alias("text"))


SAID = ["Le Pass-Culture aide", "La jeunesse attend", "Une MJC ouvre", "De l'Éducation populaire", "Un etudiant vient", "Les lycéens parlent", "Ce collegien lit", "Rien de tel", "Les étudiants et la mjc"]


@query(f"""WITH s AS (SELECT p_partkey AS doc_id, [{', '.join(quoted(x) for x in SAID)}][p_size % {len(SAID)} + 1] || '.' AS m, p_name || '!' AS a FROM part) SELECT doc_id, 1 AS sent_idx, m AS sentence, a AS prev, 'Fin.' AS next FROM s WHERE NOT contains(m, 'Rien')""")
def keyword_sentences(spark, d):
    """Sentences with one of the seven phrases, and their neighbours."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("p_size") % len(SAID)).cast("int") + 1)
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit("! "), said, F.lit(". Fin.")).alias("text"))
    return themes.snippets(themes.sentences(rows, "doc_id"), "doc_id")


WORDS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'http\S+', ' ', 'g'), '[^a-zàâçéèêëîïôûùüÿñæœ\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 2)"


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w)
SELECT term, count(DISTINCT doc_id) AS rows, count(*)::BIGINT AS occurrences FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""")
def theme_vocabulary(spark, d):
    """The terms that themes are made of."""
    return themes.term_counts(read(spark, d, "documents"), "doc_id")


@query(f"SELECT doc_id, array_to_string(list_transform(list_slice(w, b, b + 17), lambda x: CASE WHEN {HIT} THEN '<mark>' || x || '</mark>' ELSE x END), ' ') AS part FROM (SELECT *, greatest(1, least(greatest(1, coalesce(list_position(list_transform(w, lambda x: {HIT}), true), 1)) - 9, len(w) - 17)) AS b FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents))")
def headline_fragment(spark, d):
    return read(spark, d, "documents").select("doc_id", highlight.fragment("text", ["the", "of"]).alias("part"))
