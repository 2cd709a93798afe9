"""URL allow and block rules by a sort-merge range join.

A host read from its last label on (`com.example.www.`) turns "this host and its subdomains" into an
interval of keys that start alike. Rules and pages are sorted together by that key; one sweep keeps the
stack of the rules whose interval is open, and a page takes the longest rule on the stack that its path fits.

Pages are dealt to ranges of (key, row hash), so even one host with a third of all pages is split; a rule
goes to each range that its interval touches, never to the driver.

Defined results: a null url or one without `://` has an empty host and path and fits no rule. A page that
fits no rule gets the default verdict and a null rule. Repeated pages are each judged; of repeated rules
the one whose verdict comes first by code point is taken. No pages give no rows; no rules judge all by the
default. Only the id and url columns are read, so further columns of any name don't matter.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, scan_tasks, table

PAGE, RULE = 1, 0


def url_parts(url):
    """Host (lower-cased) and path of a url, as columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host):
    """`www.example.com` as `com.example.www.`"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """One pass over rules and pages sorted by (range, key, kind); a stack holds the open rules."""
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
    at = None
    for batch in batches:
        rules, verdicts, keep = [], [], []
        for i, (part, key, kind, path, rule, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "key", "kind", "path", "rule", "verdict")), strict=True)):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == RULE:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, own, lengths = stack[-1]
                if path not in own or verdict < own[path][1]:
                    own[path] = (rule, verdict)
                    lengths[:] = sorted({len(p) for p in own}, reverse=True)
                continue
            best = None
            for _, own, lengths in stack:
                for n in lengths:
                    if (hit := own.get(path[:n])) and n <= len(path):
                        if best is None or len(hit[0]) >= len(best[0]):
                            best = hit
                        break
            keep.append(i)
            rules.append(best and best[0])
            verdicts.append(best and best[1])
        if keep:
            got = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([got.column("id"), got.column("host"), got.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Per page: id, host, path, the longest rule that fits (host and path prefix) and the verdict.

    rules: columns host, path (a prefix) and verdict. ranges: how many sorted ranges the pages are dealt to.
    """
    spark = pages.sparkSession
    n = ranges or scan_tasks(spark)
    host, path = url_parts(F.col("_url"))
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url")).select("id", host.alias("host"), path.alias("path"), F.xxhash64("_url", "id").alias("salt")).withColumn("key", host_key(F.col("host")))
    # Bounds come from a hash sample of fixed size; they set the balance only, not the result.
    sample = sorted((r[0], r[1]) for r in keyed.select("key", "salt").orderBy(F.xxhash64("salt")).limit(20 * n).collect())
    bounds = sorted({sample[i] for i in range(20, len(sample), 20)})

    def placed(batches):
        for b in batches:
            part = [bisect_right(bounds, x) for x in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(b.column(c) for c in ("key", "id", "host", "path"))], ["part", "key", "id", "host", "path"])

    def covered(batches):
        for b in batches:
            for row in b.to_pylist():
                lo = bisect_left(bounds, (row["key"], -(2**63)))
                hi = bisect_right(bounds, (row["key"] + "\U0010ffff", 2**63))
                yield pa.RecordBatch.from_pylist([row | {"part": p} for p in range(lo, hi + 1)], pa.schema([("part", pa.int32()), ("key", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())]))

    kind = dict(pages.dtypes)[id_col]
    sides = keyed.mapInArrow(placed, f"part int, key string, id {kind}, host string, path string")
    opened = rules.select(host_key(ascii_lower(F.col("host"))).alias("key"), F.coalesce("path", F.lit("")).alias("path"), F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), "verdict").where("key IS NOT NULL AND verdict IS NOT NULL")
    opened = opened.mapInArrow(covered, "part int, key string, path string, rule string, verdict string")
    both = sides.select("part", "key", F.lit(PAGE).alias("kind"), "path", "id", "host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).unionByName(
        opened.select("part", "key", F.lit(RULE).alias("kind"), "path", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("host"), "rule", "verdict")
    )
    swept = both.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "kind").mapInArrow(sweep, f"id {kind}, host string, path string, rule string, verdict string")
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The rules of the query: verdict, host, path prefix.
QUERY_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op2_url_rules(spark, sf_dir):
    rules = spark.createDataFrame([(h, p, v) for v, h, p in QUERY_RULES], "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM cut
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
