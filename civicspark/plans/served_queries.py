"""Queries of results as they are served, of stored tables, streams and deep places. Roles as in `catalog`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import caches, choices, density, logs, paging, served, stored, themes
from ..storage import remove, shared_dir
from ..streaming import counters
from .catalog import ANSWERS, PAGE, PICKS, SHOWN, TOKENS, indexed, options, pct, picks, query, read, survey
from .index_queries import fragment_sql
from .page_queries import REQUESTS, _ingested, _lines, WIDE

# ---- pages


def _searches(spark, d):
    """Events as searches: the clicks asked for the query, all others for their own type."""
    events = read(spark, d, "events")
    return caches.popularity(events.select(F.when(F.col("event_type") == "click", " THE with").otherwise(F.col("event_type")).alias("query"), "ts"))


FOUND = f"SELECT doc_id FROM documents WHERE length(trim(text)) >= 60 AND list_has_all({TOKENS}, ['the', 'with']) ORDER BY doc_id DESC LIMIT 20"


@query(f"""WITH p AS (SELECT {PAGE} WHERE doc_id IN ({FOUND})), f AS ({fragment_sql(['the', 'with'])}), n AS (SELECT count(*) AS n FROM events WHERE event_type = 'click')
SELECT p.*, part AS marked, CAST(n AS INT) AS popularity, CASE WHEN n >= 1000 THEN 60 WHEN n >= 100 THEN 45 WHEN n >= 20 THEN 30 WHEN n >= 5 THEN 15 ELSE 5 END AS ttl FROM p JOIN f ON f.doc_id = p.answer_id, n""")
def search_page_served(spark, d):
    """Hits, authors, the marked best part, popularity and life time in one result."""
    out = served.served_search(*survey(spark, d), "the with", _searches(spark, d), indexed(spark, d))
    return out.select(*SHOWN, "marked", "popularity", "ttl")


@query(f"SELECT {PAGE} WHERE doc_id IN ({FOUND})")
def search_page_cached(spark, d):
    """The second call is answered from the stored cache."""
    folder, now = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", F.lit("2031-01-01").cast("timestamp_ntz")
    compute = lambda: served.served_search(*survey(spark, d), "the with", _searches(spark, d), indexed(spark, d)).select(*SHOWN)
    served.through_cache(spark, folder, " The with", None, now, compute)
    rows, hit = served.through_cache(spark, folder, "the With ", "", now, compute)
    return rows.where(F.lit(hit))


BUSIEST = "(SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"""WITH a AS (SELECT doc_id AS id, lang AS question_id, o_orderdate AS submitted_at, text FROM documents JOIN orders ON o_orderkey = doc_id WHERE source = {BUSIEST} AND length(trim(text)) >= 60 AND list_contains({TOKENS}, 'the')),
n AS (SELECT count(*) AS total FROM a) SELECT a.*, total, greatest(1, CAST(ceil(total / 5.0) AS BIGINT)) AS pages FROM a, n ORDER BY submitted_at DESC NULLS FIRST, id DESC LIMIT 5 OFFSET 5""")
def author_page_search(spark, d):
    """The second page of a source's answers with a word in them."""
    docs = read(spark, d, "documents")
    busiest = docs.where("source IS NOT NULL").groupBy("source").count().orderBy(F.desc("count"), "source").first()["source"]
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("question_id"), F.col("doc_id").alias("contribution_id"), "text")
    given = docs.select("doc_id", "source").join(read(spark, d, "orders"), F.col("doc_id") == F.col("o_orderkey")).select(F.col("doc_id").alias("id"), F.col("source").alias("author_id"), F.col("o_orderdate").alias("submitted_at"))
    return served.author_page(rows, given, busiest, "the", 2, 5)


@query(f"SELECT question_id, option_id, label, position, count, coalesce({pct('count', 'nullif(sum(count) OVER (PARTITION BY question_id), 0)')}, 0.0) AS percentage FROM ({PICKS})")
def dashboard_cached(spark, d):
    """Statistics of all forms, stored as JSON by form and read back from the stored cache."""
    folder, now = f"{shared_dir(spark)}/dash-{uuid.uuid4().hex}", F.lit("2031-01-01").cast("timestamp_ntz")
    stats = choices.single_choice_stats(options(spark, d), picks(spark, d)).select("question_id", "option_id", "label", "position", "count", "percentage")
    entries = served.stats_entries(stats, "question_id", now)
    stored.merge_stored(folder, entries, ["cache_key"], parts=8)
    stored.merge_stored(folder, entries, ["cache_key"], parts=8)  # again: nothing is written
    kinds = dict(stats.dtypes)
    return served.from_entries(stored.read_stored(spark, folder), "question_id", kinds["question_id"], ", ".join(f"{c} {kinds[c]}" for c in stats.columns if c != "question_id"))


@query(f"""WITH r AS (SELECT '10.0.0.' || user_id AS ip, [{', '.join(str(s) for s, _ in REQUESTS)}][event_id % {len(REQUESTS)} + 1] AS status, [{', '.join(f"'{q}'" for _, q in REQUESTS)}][event_id % {len(REQUESTS)} + 1] AS request FROM events WHERE event_id % 97 <> 0)
SELECT 'page' AS kind, split_part(request, ' ', 2) AS value, count(*) AS requests, count(DISTINCT ip) AS visitors, 0::BIGINT AS errors FROM r WHERE status = 200 AND request LIKE 'GET %' AND NOT starts_with(split_part(request, ' ', 2), '/static/') GROUP BY 2
UNION ALL SELECT 'status', status::VARCHAR, count(*), count(DISTINCT ip), count(*) FILTER (WHERE status >= 400) FROM r GROUP BY 2""")
def requests_by_page_and_status(spark, d):
    return served.page_rollup(logs.parse(_lines(spark, d)))


@query()
def mood_of_holdout(spark, d):
    """Quality as the mood: learnt on the labelled documents whose id's remainder by 5 isn't 0, told for all documents."""
    docs, labels = read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "labels")
    known = docs.join(labels, "doc_id").where("doc_id % 5 <> 0")
    return themes.learnt_mood(docs, known, "quality").select("doc_id", "mood")


@query(f"""WITH {WIDE}, o AS (SELECT DISTINCT p_brand AS b FROM k UNION SELECT DISTINCT p_type FROM k)
SELECT 'rows' AS kind, 'contributions' AS name, count(*) AS value FROM k UNION ALL SELECT 'rows', 'authors', count(DISTINCT p_brand) FROM w UNION ALL SELECT 'rows', 'forms', 1 UNION ALL SELECT 'rows', 'questions', 5
UNION ALL SELECT 'many options', 'marks', count(*) FROM o HAVING count(*) > 10""")
def ingest_dry_run(spark, d):
    from .page_queries import MAPPING, _wide

    return served.dry_run(_wide(spark, d), MAPPING, warn=10, order="line").where("kind = 'many options' OR name IN ('contributions', 'authors', 'forms', 'questions')")


# ---- stored tables and streams


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS id, CASE WHEN n > 5 THEN 'busy' ELSE c_name END AS name, c_nationkey::BIGINT + coalesce(n, 0) AS score FROM customer LEFT JOIN o ON k = c_custkey
UNION ALL SELECT s_suppkey + 10000000, s_name, s_nationkey::BIGINT FROM supplier""")
def stored_merge(spark, d):
    """Customers, then their orders' counts and the suppliers merged into one stored table; the second merge is run again with what doesn't add."""
    folder = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("score"))
    stored.merge_stored(folder, people, ["id"], parts=16)
    busy = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.count("*") > 5, "busy").alias("name"), F.count("*").alias("score"))
    busy = busy.join(people.select("id"), "id", "left_semi")
    stored.merge_stored(folder, busy, ["id"], {"name": stored.fill, "score": stored.add}, parts=16)
    more = read(spark, d, "supplier").select((F.col("s_suppkey") + 10000000).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("score"))
    stored.merge_stored(folder, more, ["id"], parts=16)
    if stored.merge_stored(folder, more, ["id"], parts=16):
        raise AssertionError("a merge that is run again wrote partitions")
    return stored.read_stored(spark, folder)


@query(f"WITH {WIDE} SELECT ref AS reference, p_name AS title FROM k")
def stored_survey(spark, d):
    """An ingest merged into stored tables twice."""
    folder = f"{shared_dir(spark)}/survey-{uuid.uuid4().hex}"
    for turn in range(2):
        stored.store_survey(_ingested(spark, d, keep=f"{folder}/file{turn}"), folder, 4)
        remove(spark, f"{folder}/file{turn}")
    return stored.read_stored(spark, f"{folder}/contributions").select(F.col("source_contribution_id").alias("reference"), "title")


@query("SELECT u AS question_id, count(*) AS answers_count FROM (SELECT user_id % 300 AS a, arg_max(CASE WHEN event_type <> 'error' THEN CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END END, event_id) AS u, arg_max(event_type, event_id) AS e FROM events GROUP BY 1) WHERE e <> 'error' GROUP BY 1")
def stream_counts(spark, d):
    """Events as a stream of answers' changes: an answer moves between questions, errors delete it."""
    folder = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    kind = F.col("event_type")
    question = F.when(kind == "click", 1).when(kind == "view", 2).when(kind == "signup", 3).when(kind != "error", 4)
    source = read(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    changes = stream.select((F.col("user_id") % 300).alias("answer_id"), question.alias("question_id"), F.when(kind == "error", "delete").otherwise("update").alias("op"), F.col("event_id").alias("seq"))
    counters.keep_changed_counts(changes, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return counters.read_question_counts(spark, f"{folder}/out").where("answers_count > 0")


# ---- deep places


@query("SELECT l_orderkey AS o, l_linenumber AS n, l_shipdate AS at FROM lineitem ORDER BY l_shipdate DESC NULLS FIRST, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 20 OFFSET 45678")
def deep_page(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_shipdate").alias("at"), "l_partkey", "l_suppkey")
    return paging.deep_page(rows, [(c, "desc") for c in ("at", "o", "n", "l_partkey", "l_suppkey")], 45678, 20, 500).select("o", "n", "at")


@query("SELECT g, p, shipped, k, total FROM (SELECT l_returnflag AS g, l_partkey AS p, l_shipdate AS shipped, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER (PARTITION BY l_returnflag) AS total FROM lineitem) WHERE k = least(9000, total)")
def deep_kth(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_shipdate").alias("shipped"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("p"), "l_suppkey")
    return paging.kth_deep(rows, "g", [(c, "asc") for c in ("shipped", "l_orderkey", "l_linenumber", "p", "l_suppkey")], 9000).select("g", "p", "shipped", "k", "total")


# ---- themes by density


@query()
def density_themes_of_texts(spark, d):
    """Documents by their words: clusters of five rows or more that last longest; null is noise."""
    vectors = density.word_vectors(read(spark, d, "documents"), "doc_id")
    return density.density_themes(vectors, "doc_id", "vector", least=5, k=10, levels=8)
