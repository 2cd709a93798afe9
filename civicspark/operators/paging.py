"""Pages: keyset cursors, offsets, and the cursor's text form."""

from __future__ import annotations

import base64
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import PER_PAGE
from ..storage import shared_dir


def encode_cursor(values: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, separators=(",", ":"), default=str).encode()).decode().rstrip("=")


def decode_cursor(text: str | None) -> dict | None:
    """None for what isn't a cursor: the first page."""
    try:
        out = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except Exception:  # noqa: BLE001  any text can come in
        return None
    return out if isinstance(out, dict) else None


def after(keys: list[tuple[str, str]], last: dict) -> Column:
    """Rows behind `last` in the order of keys (name, "asc" or "desc"); nulls come first in descending order, last in ascending."""
    out, equal = F.lit(False), F.lit(True)
    for name, way in keys:
        c, v = F.col(name), last.get(name)
        if v is None:
            behind = c.isNotNull() if way == "desc" else F.lit(False)
        else:
            behind = (c < F.lit(v)) if way == "desc" else (c > F.lit(v)) | c.isNull()
        out = out | (equal & F.coalesce(behind, F.lit(False)))
        equal = equal & c.eqNullSafe(F.lit(v))
    return out


def ordered(keys: list[tuple[str, str]]) -> list[Column]:
    return [F.col(k).desc_nulls_first() if way == "desc" else F.col(k).asc_nulls_last() for k, way in keys]


def page(df: DataFrame, keys: list[tuple[str, str]], last: dict | None = None, size: int = PER_PAGE) -> DataFrame:
    """A page's rows (top-k, no full sort); keys must tell rows apart."""
    return (df if last is None else df.where(after(keys, last))).orderBy(*ordered(keys)).limit(size)


def paginate(df: DataFrame, keys: list[tuple[str, str]], cursor: str | None = None, size: int = PER_PAGE) -> tuple[list, bool, str | None]:
    """Rows of a page, whether more follow, and the cursor of the next: the last row that was shown."""
    rows = page(df, keys, decode_cursor(cursor), size + 1).collect()
    more = len(rows) > size
    rows = rows[:size]
    return rows, more, encode_cursor({k: rows[-1][k] for k, _ in keys}) if more else None


def offset_page(df: DataFrame, keys: list[tuple[str, str]], number: int, size: int = PER_PAGE) -> DataFrame:
    return df.orderBy(*ordered(keys)).offset(max(0, number - 1) * size).limit(size)


def total_pages(total, size: int = PER_PAGE) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")




#: Ranges of a key that are counted at once.
RANGES = 1024
#: Shares that the rows of a group are dealt to.
SALTS = 64


def _code(df: DataFrame, name: str) -> Column:
    """A key as a whole number in the same order; null is the largest, as in `ordered`."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind.startswith("timestamp"):
        c = F.unix_micros(c.cast("timestamp"))
    elif kind == "date":
        c = F.unix_date(c)
    elif kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name} is {kind}: deep places need whole numbers, dates or timestamps")
    return F.coalesce(c.cast("long"), F.lit(2**62))


def _whole(a: Column, b: Column) -> Column:
    """a DIV b of large whole numbers, a >= 0, where the result is small."""
    return F.round((a - F.pmod(a, b)) / b).cast("long")


def deep_page(df: DataFrame, keys: list[tuple[str, str]], offset: int, size: int = PER_PAGE, most: int = 10_000) -> DataFrame:
    """The rows of places offset to offset + size in an order, without sorting or sending those before.

    The first key's range is cut into RANGES parts, whose rows are counted; the part that holds the place is cut again, until it holds `most` rows or a
    single value, after which the next key goes on. Then rows from that part on are ordered, of which each task keeps `most` and a page. Counts
    are partial sums, a row for each part. A place may lie where all keys are equal: keys that tell rows apart make that one row.
    """
    rows, before, equal = df, 0, F.lit(True)
    for name, way in keys:
        code = _code(df, name) if way == "asc" else -_code(df, name)
        span = rows.where(equal).agg(F.min(code), F.max(code)).first()
        if span[0] is None:
            return df.limit(0)
        lo, hi = span
        held = None
        while lo < hi and (held is None or held > most):
            step = max(1, -(-(hi - lo + 1) // RANGES))
            inside = rows.where(equal & (code >= lo) & (code <= hi))
            counts = sorted(tuple(r) for r in inside.groupBy(_whole(code - F.lit(lo), F.lit(step)).alias("part")).agg(F.count("*"), F.min(code), F.max(code)).collect())
            for part, n, least, largest in counts:
                if before + n > offset or part == counts[-1][0]:
                    lo, hi, held = least, largest, n
                    break
                before += n
        rows = rows.where(~equal | (code >= lo))  # behind an equal start of the keys, what comes before the part is done with
        if lo < hi:
            break
        equal = equal & (code == lo)
    return rows.orderBy(*ordered(keys)).offset(max(0, offset - before)).limit(size)


def kth_deep(df: DataFrame, group: str, keys: list[tuple[str, str]], k: int, passes: int = 2, most: int = 100_000) -> DataFrame:
    """The k-th row of each group (k from 1; of smaller groups the last) with k and total, for a k of any size.

    As `deep_page`, for all groups at once: each pass counts the parts of every group's range by a key and keeps the rows of the part
    that holds the place; the next key goes on where a part of one value has more than `most` rows. So few rows a group are numbered in the end. Groups
    are rows of a stored table, none comes to the driver; each is there for every one of SALTS shares of the rows, so that no task gets all rows of one.
    """
    spark, folder = df.sparkSession, f"{shared_dir(df.sparkSession)}/kth-{uuid.uuid4().hex}"
    codes = [_code(df, name) if way == "asc" else -_code(df, name) for name, way in keys]
    rows = df.withColumn("_salt", F.pmod(F.hash(*(name for name, _ in keys)), F.lit(SALTS)))
    written: list[DataFrame] = []

    def put(spans: DataFrame) -> DataFrame:
        path = f"{folder}/{len(written)}"
        spans.write.parquet(path)
        written.append(spark.read.parquet(path))
        return written[-1]

    def held(spans: DataFrame, upto: int) -> DataFrame:
        """Rows within their group's ranges of the first keys."""
        dealt = spans.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.join(dealt, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_salt") == F.col("_share"))).drop("_salt", "_share")
        for i in range(upto):
            out = out.where((code(i) >= F.col(f"_lo{i}")) & (code(i) <= F.col(f"_hi{i}")))
        return out

    def code(i: int) -> Column:
        """A key counts where all keys before it have one value."""
        one = F.lit(True)
        for j in range(i):
            one = one & (F.col(f"_lo{j}") == F.col(f"_hi{j}"))
        return F.when(one, codes[i]).otherwise(F.lit(0).cast("long")) if i else codes[0]

    spans = df.groupBy(F.col(group).alias("_g")).agg(F.min(codes[0]).alias("_lo0"), F.max(codes[0]).alias("_hi0"), F.count("*").alias("total"))
    spans = put(spans.withColumn("k", F.least(F.lit(max(1, k)).cast("long"), "total")).withColumn("_before", F.lit(0).cast("long")).withColumn("_n", F.col("total")))
    used = 0
    for i in range(len(keys)):
        lo, hi, fixed = f"_lo{i}", f"_hi{i}", ["_g", "k", "total", "_before", *(f"_{x}{j}" for j in range(i) for x in ("lo", "hi"))]
        if i:
            if spans.where(F.col("_n") > most).isEmpty():
                break
            spans = put(held(spans, i).groupBy(*fixed).agg(F.min(code(i)).alias(lo), F.max(code(i)).alias(hi), F.count("*").alias("_n")))
        used, done = i + 1, 0
        while done < passes or not spans.where((F.col("_n") > most) & (F.col(lo) < F.col(hi))).isEmpty():
            step = F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo) + 1) / RANGES)).cast("long")
            parts = held(spans, used).groupBy(*fixed, _whole(code(i) - F.col(lo), step).alias("_part")).agg(F.count("*").alias("_n"), F.min(code(i)).alias(lo), F.max(code(i)).alias(hi))
            upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_part"))  # RANGES rows a group at most
            parts = parts.withColumn("_upto", F.col("_before") + upto).where((F.col("_upto") >= F.col("k")) & (F.col("_upto") - F.col("_n") < F.col("k")))
            spans = put(parts.select(*(c for c in fixed if c != "_before"), lo, hi, (F.col("_upto") - F.col("_n")).alias("_before"), "_n"))
            done += 1
    last = held(spans, used)
    place = F.col("_before") + F.row_number().over(Window.partitionBy(group).orderBy(*ordered(keys)))
    return last.withColumn("_place", place).where(F.col("_place") == F.col("k")).select(*df.columns, "k", "total")
