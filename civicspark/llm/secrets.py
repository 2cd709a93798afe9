"""Secret scans from DataFrame functions alone: pattern spans, and a battery of randomness tests for bare tokens.

Base spans are the leftmost non-overlapping matches of three patterns. The battery judges all bare tokens of 20 or
more characters, less what base spans cover of them (pieces of 20 or more stay). Each is read in the encoding that its characters allow (hex, base32, base62, base64, or both kinds of base64 signs at once) and is
held against "uniform over that alphabet" by a chi-squared test of the symbol counts, a runs test of the upper
and lower half of the alphabet, and the lag-1 serial correlation; a token that fails one is no secret. What
passes is held against "ordinary text", where characters change class (digit, lower, upper, sign) at a rate of
`text_rate` at most: the Chernoff bound of the binomial tail for its number of changes is a p-value that falls
with the token's length. Benjamini-Hochberg over all tokens of the corpus, by a histogram of fixed size, keeps
the share of false discoveries under `fdr`.

Starts and ends come from marking matches with three control characters; where a text has these itself they
are first mapped to a fourth, which no pattern matches, so places stay right. All of it is code points.

Defined results: a null or empty text has no spans and the digest of the empty string. Repeated rows get a
row each. Ties in start go by kind: assign, access, hex, random. Only the id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, table

KINDS = ("assign", "access", "hex", "random")
#: Fixed values of the contract: what is before the value, the value, and the least length of the value.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"()(AKIA[A-Z0-9]+)", 18),
    "hex": (r"()([0-9a-f]++)", 16),
    "random": (r"()([A-Za-z0-9+/_-]{20,}+={0,2})", 20),
}
SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
BINS, BINS_A_NAT = 8192, 10

#: Symbols by encoding; a token is read in the first that holds all of it.
ALPHABETS = [
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]


def matches(text: str, kind: str) -> str:
    """SQL: all matches of a kind in a column, long enough ones only, as structs of start, kind, end, value."""
    pattern, least = PATTERNS[kind]
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    if kind == "hex":
        quoted = quoted.replace("++", f"{{{least},}}+")  # maximal runs either way
    marked = f"split(regexp_replace({text}, '{quoted}', '\\u0001$1\\u0002$2\\u0003'), '\\u0001')"
    found = f"""aggregate(slice(m, 2, greatest(size(m) - 1, 0)), struct(char_length(m[0]) AS at, CAST(array() AS {SPAN}) AS got),
      (a, p) -> struct(a.at + char_length(p) - 2 AS at, IF(locate('\\u0003', p) - locate('\\u0002', p) - 1 < {least}, a.got, concat(a.got, array(struct(a.at AS s, {KINDS.index(kind)} AS k, a.at + locate('\\u0003', p) - 2 AS e, substring_index(substring_index(p, '\\u0003', 1), '\\u0002', -1) AS v)))) AS got), a -> a.got)"""
    return f"transform(array({marked}), m -> {found})[0]"


def normal_tail(z: str) -> str:
    """SQL: the two-sided tail of a standard normal, by a logistic form (off by 0.0002 at most)."""
    return f"(2 / (1 + exp(least(700D, 1.5976 * abs({z}) + 0.070565992 * pow(abs({z}), 3)))))"


def battery(alpha: float, text_rate: float) -> str:
    """SQL for `token -> p-value against ordinary text`, or null where the token fails a randomness test."""
    letters = "CASE " + " ".join(f"WHEN rtrim('=', c.v) RLIKE '{p}' THEN '{a}'" for p, a in ALPHABETS) + " END"
    # Steps: symbols as codes; counts and moments; the tests. transform(array(x), f)[0] names a step once.
    codes = f"transform(array(struct({letters} AS abc, rtrim('=', c.v) AS w)), t -> struct(char_length(t.abc) AS k, char_length(t.w) AS n, transform(filter(split(t.w, ''), h -> h <> ''), h -> locate(h, t.abc) - 1) AS x, transform(filter(split(t.w, ''), h -> h <> ''), h -> CASE WHEN h BETWEEN '0' AND '9' THEN 0 WHEN h BETWEEN 'a' AND 'z' THEN 1 WHEN h BETWEEN 'A' AND 'Z' THEN 2 ELSE 3 END) AS g))[0]"
    moments = """struct(t.k AS k, t.n AS n,
      aggregate(sequence(0, t.k - 1), 0D, (a, i) -> a + pow(size(filter(t.x, y -> y = i)), 2)) * t.k / t.n - t.n AS chi,
      CAST(size(filter(t.x, y -> y * 2 >= t.k)) AS DOUBLE) AS hi,
      1D + size(filter(sequence(0, t.n - 2), i -> (t.x[i] * 2 >= t.k) <> (t.x[i + 1] * 2 >= t.k))) AS runs,
      aggregate(t.x, 0D, (a, y) -> a + y) / t.n AS mean, t.x AS x,
      size(filter(sequence(0, t.n - 2), i -> t.g[i] <> t.g[i + 1])) / (t.n - 1D) AS change)"""
    scores = """struct(u.n AS n, u.change AS change,
      (pow(u.chi / (u.k - 1), 1D/3) - (1 - 2D / (9 * (u.k - 1)))) / sqrt(2D / (9 * (u.k - 1))) AS z1,
      IF(u.hi = 0 OR u.hi = u.n, 99D, (u.runs - 1 - 2 * u.hi * (u.n - u.hi) / u.n) / sqrt(greatest(1e-9, 2 * u.hi * (u.n - u.hi) * (2 * u.hi * (u.n - u.hi) - u.n) / (u.n * u.n * (u.n - 1D))))) AS z2,
      (aggregate(sequence(0, u.n - 2), 0D, (a, i) -> a + (u.x[i] - u.mean) * (u.x[i + 1] - u.mean)) / greatest(1e-9, aggregate(u.x, 0D, (a, y) -> a + pow(y - u.mean, 2))) + 1D / u.n) * sqrt(u.n) AS z3)"""
    kl = f"v.change * ln(greatest(v.change, 1e-9) / {text_rate}D) + (1 - v.change) * ln(greatest(1 - v.change, 1e-9) / {1 - text_rate}D)"
    least = " AND ".join(f"{normal_tail(f'v.z{i}')} >= {alpha / 3}D" for i in (1, 2, 3))
    # A token that changes class no oftener than text has the p-value 1 whatever the tests say (both count as no secret), so these aren't run: at most one change in 1 / text_rate characters.
    classes = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(rtrim('=', c.v), '[0-9]+', '\\u0001'), '[a-z]+', '\\u0002'), '[A-Z]+', '\\u0003'), '[+/_-]+', '\\u0004')"
    whole = f"transform(transform(transform(array({codes}), t -> {moments}), u -> {scores}), v -> IF({least}, IF(v.change <= {text_rate}D, 1D, exp(-(v.n - 1) * ({kl}))), NULL))[0]"
    return f"IF(char_length({classes}) - 1 <= {text_rate}D * (char_length(rtrim('=', c.v)) - 1), 1D, {whole})"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01, alpha: float = 0.001, text_rate: float = 0.08, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns in `keep`, base and all spans as arrays of struct(s, k, e): start, kind, end.

    fdr: the false-discovery share allowed among added spans. alpha: the level at which the three randomness
    tests together reject a random token. text_rate: class changes a character in ordinary text, at most.
    """
    tables = Tables(docs.sparkSession, "secrets")
    clean = docs.select(F.col(id_col), *(c for c in keep), F.translate(F.coalesce(F.col(text_col), F.lit("")), "\u0001\u0002\u0003", "\u0004\u0004\u0004").alias("_text"))
    found = clean.select(id_col, *keep, *(F.expr(matches("_text", k)).alias(f"_{k}") for k in KINDS))
    # A token is cut at the base spans that it meets; spans are few where there are any.
    cut = f"aggregate(filter(_base, b -> b.s < t.e AND t.s < b.e), array(struct(t.s AS s, t.e AS e)), (a, b) -> flatten(transform(a, x -> IF(b.s < x.e AND x.s < b.e, array(struct(x.s AS s, b.s AS e), struct(b.e AS s, x.e AS e)), array(x)))))"
    least = PATTERNS["random"][1]
    bare = f"flatten(transform(_random, t -> transform(filter({cut}, x -> x.e - x.s >= {least}), x -> struct(x.s AS s, t.k AS k, x.e AS e, substr(t.v, x.s - t.s + 1, x.e - x.s) AS v))))"
    found = found.withColumn("_base", F.expr("array_sort(transform(concat(_assign, _access, _hex), c -> struct(c.s AS s, c.k AS k, c.e AS e)))"))
    found = found.withColumn("_bare", F.expr(f"filter(transform({bare}, c -> struct(c.s AS s, c.k AS k, c.e AS e, {battery(alpha, text_rate)} AS p)), c -> true)"))
    found = tables.put(found.select(id_col, *keep, "_base", "_bare"))
    tested = found.selectExpr("explode(_bare.p) AS p")
    counts = tested.groupBy(F.expr(f"CAST(IF(p IS NULL, 0, least({BINS - 1}, floor(-ln(greatest(p, 1e-300)) * {BINS_A_NAT}))) AS INT)").alias("bin")).count().collect()  # BINS rows at most
    total, seen, cut = sum(r["count"] for r in counts), 0, None
    for r in sorted(counts, key=lambda r: -r["bin"]):
        seen += r["count"]
        if r["bin"] > 0 and math.exp(-r["bin"] / BINS_A_NAT) <= fdr * seen / total:
            cut = r["bin"]
    more = "CAST(array() AS array<struct<s:int,k:int,e:int>>)" if cut is None else f"transform(filter(_bare, c -> c.p IS NOT NULL AND -ln(greatest(c.p, 1e-300)) * {BINS_A_NAT} >= {cut}), c -> struct(c.s AS s, c.k AS k, c.e AS e))"
    return found.select(id_col, *keep, F.col("_base").alias("base_spans"), F.expr(f"array_sort(concat(_base, {more}))").alias("spans"))


def span_list(column: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({column}, x -> concat_ws(':', array({names})[x.k], x.s, x.e)), ',')"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with each span replaced by a mark; rows without spans stay as they are. Same columns, same rows."""
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_body"))
    found = find_secrets(rows, "_id", "_body", keep=("_row", "_body"))
    fixed = f"""transform(array(aggregate(spans, struct(0 AS at, '' AS got), (a, x) -> IF(x.e <= a.at, a, struct(x.e AS at, concat(a.got, substr(_body, a.at + 1, greatest(x.s - a.at, 0)), IF(x.s < a.at, '', '{mark}')) AS got)))), a -> concat(a.got, substr(_body, a.at + 1)))[0]"""
    return found.select(F.col("_row").withField(text_col, F.expr(f"IF(size(spans) = 0, _body, {fixed})")).alias("_row")).select("_row.*")


def op8_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda k: F.expr(f"CAST(size(filter(base_spans, x -> x.k = {KINDS.index(k)})) AS BIGINT)").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.expr(span_list("base_spans")).cast("binary"), 256).alias("base_sha256"), F.expr(span_list("spans")).alias("spans"), F.expr("CAST(size(spans) - size(base_spans) AS BIGINT)").alias("n_random"))
