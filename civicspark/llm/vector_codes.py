"""Vector code compression: a codebook for each part of the vectors, by Lloyd rounds with Elkan's bounds.

A vector's components become integers; the vector is cut into equal parts, and a part's code is the number of the nearest
entry of the part's codebook. The first assignment measures all entries. With it go, for each vector and part, an upper
bound of the distance to its entry and one lower bound for each entry, kept as bytes in units of the part's own, rounded down. A later
round shifts the bounds by how far the entries moved, drops every entry that the bounds or the entries' own distances put
strictly beyond the assigned one, and measures what is left in integers, so ties go to the lower index exactly.

The codebooks are the only thing that the driver holds: parts x entries x the part's width numbers, whatever the table's
size; tasks give their sums and counts for each entry, which are added up by part and entry. Vectors and bounds are
tables in the shared folder; a round reads one and writes the next.

Defined results: rows whose vector is null, empty or holds null or non-finite components are dropped, and so are vectors of
another length than the one with the smallest id. Null ids come last in the order that starts the codebooks; repeated
ids are ordered by their vectors, and each row counts. With fewer rows than entries the codebooks are that small. No rows
give no rows. Null labels are one label. Components beyond 2^28 / scale are an error, as sums of squares must be exact. Other
columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, table

#: Rows that a task holds bounds of at once.
ROWS = 2048
#: The largest integer component: four of its differences squared stay under 2^62.
MOST = 1 << 28
STATE = "id {kind}, label {label}, x array<int>, code binary, upper binary, unit binary, lower binary"


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries of the same width."""
    d = x - entries
    return (d * d).sum(-1)


def above(x: np.ndarray) -> np.ndarray:
    """A little more than x, so that rounding never makes an upper bound too small."""
    return np.asarray(x, np.float64) * (1 + 1e-6) + 1e-9


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.asarray(x, np.float64) * (1 - 1e-6) - 1e-9, 0)


def first_codes(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: its nearest entry (the lowest of equal ones), its squared distance, and lower bounds for all entries."""
    d = np.stack([squares(x, e) for e in entries], 1)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code], below(np.sqrt(d))


def next_codes(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As first_codes, after entries have moved, with the bounds from before; and how many distances were measured.

    An entry is passed over only where a bound says that it is strictly farther than the assigned one.
    """
    half = below(np.sqrt(squares(entries[:, None, :], entries[None, :, :]).astype(np.float64))) / 2
    upper = above(upper) + above(moved)[code]
    lower = np.maximum(lower - above(moved)[None, :], 0)

    def near(rows: np.ndarray) -> np.ndarray:
        out = (lower[rows] <= upper[rows, None]) & (half[code[rows]] <= upper[rows, None])
        out[np.arange(len(rows)), code[rows]] = False
        return out

    rows = np.arange(len(x))
    rows = rows[near(rows).any(1)]
    exact = squares(x, entries[code])  # the assigned entry's own distance: one a row
    upper = above(np.sqrt(exact))
    lower[np.arange(len(x)), code] = below(np.sqrt(exact))
    at, entry = np.nonzero(near(rows)) if len(rows) else (np.zeros(0, int), np.zeros(0, int))
    at = rows[at]
    found = squares(x[at], entries[entry])
    lower[at, entry] = below(np.sqrt(found))
    # the least distance, then the lowest index, among the assigned entry and those measured
    best, best_code = exact.copy(), code.copy()
    order = np.lexsort((entry, found, at))
    at, entry, found = at[order], entry[order], found[order]
    lead = np.ones(len(at), bool)
    lead[1:] = at[1:] != at[:-1]
    at, entry, found = at[lead], entry[lead], found[lead]
    closer = (found < best[at]) | ((found == best[at]) & (entry < best_code[at]))
    best[at[closer]], best_code[at[closer]] = found[closer], entry[closer]
    return best_code, best, lower, len(order) + len(x)


def packed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows)])


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def integers(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), parts, -1)


def in_units(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes: how many whole units fit, the unit being a 255th of the row's largest."""
    unit = np.maximum(lower.max(1) / 254, 1e-30).astype(np.float32)
    return unit, np.minimum(np.floor(lower / unit[:, None].astype(np.float64)), 255).astype(np.uint8)


def assigner(books: np.ndarray, before: np.ndarray | None):
    """State rows of a round. before: the entries that the bounds were made with; none in the first round."""
    parts, entries = books.shape[:2]
    moved = None if before is None else np.sqrt(squares(books, before).astype(np.float64))

    def assign(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                x, n = integers(batch.column("x"), parts), batch.num_rows
                code, upper, unit = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
                lower = np.zeros((n, parts, entries), np.uint8)
                if moved is not None:
                    was, had, units = unpacked(batch.column("code"), np.uint8, parts), unpacked(batch.column("upper"), np.float32, parts), unpacked(batch.column("unit"), np.float32, parts)
                    bounds = unpacked(batch.column("lower"), np.uint8, parts * entries).reshape(n, parts, entries)
                for p in range(parts):
                    if moved is None:
                        at, d, low = first_codes(x[:, p], books[p])
                    else:
                        at, d, low, _ = next_codes(x[:, p], books[p], moved[p], was[:, p].astype(np.int64), had[:, p].astype(np.float64), below(bounds[:, p] * units[:, p, None].astype(np.float64)))
                    code[:, p], upper[:, p] = at, above(np.sqrt(d))
                    unit[:, p], lower[:, p] = in_units(low)
                kept = [batch.column(c) for c in ("id", "label", "x")]
                yield pa.RecordBatch.from_arrays([*kept, packed(code), packed(upper), packed(unit), packed(lower.reshape(n, -1))], ["id", "label", "x", "code", "upper", "unit", "lower"])

    return assign


def finisher(books: np.ndarray, before: np.ndarray | None):
    """Codes in hex and the exact error of each row, after a last round."""
    assign = assigner(books, before)

    def finish(batches):
        for batch in assign(batches):
            x, code = integers(batch.column("x"), len(books)), unpacked(batch.column("code"), np.uint8, len(books))
            error = sum(squares(x[:, p], books[p][code[:, p]]) for p in range(len(books)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes().hex() for r in code], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return finish


def adder(parts: int, entries: int, width: int):
    """A task's sums and counts for each entry: parts x entries rows of `width` sums, however many vectors it reads."""

    def add(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, code = integers(batch.column("x"), parts), unpacked(batch.column("code"), np.uint8, parts)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            own = sums[part, entry]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), *(pa.array(own[:, i]) for i in range(width))], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    return add


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: floors of the means; entries without vectors stay."""
    parts, entries, width = books.shape
    schema = "part bigint, entry bigint, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width))
    sums = state.select("x", "code").mapInArrow(adder(parts, entries, width), schema).groupBy("part", "entry").agg(F.sum("n"), *(F.sum(f"s{i}") for i in range(width)))
    out = books.copy()
    for part, entry, n, *s in sums.collect():  # parts x entries rows at most
        out[part, entry] = [v // n for v in s]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """Per kept row: id, label, code (two hex digits a part) and error; and the codebooks (part, entry, place in the part)."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code is a byte")
    tables, kinds = Tables(vectors.sparkSession, "codes"), dict(vectors.dtypes)
    finite = F.coalesce(F.forall(vector_col, lambda v: v.isNotNull() & (F.abs(v.cast("double")) <= 1.7976931348623157e308)), F.lit(False))
    x = F.transform(vector_col, lambda v: F.floor(v.cast("double") * scale))
    rows = vectors.where(finite & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    beyond = F.exists("x", lambda v: F.abs(v) > MOST)
    rows = tables.put(rows.withColumn("x", F.when(beyond, F.raise_error(F.lit(f"components beyond {MOST} / {scale} can't be summed exactly"))).otherwise(F.col("x").cast("array<int>"))))
    order = (F.col("id").asc_nulls_last(), "x")
    lead = rows.orderBy(*order).limit(1).collect()
    width = len(lead[0]["x"]) if lead else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("x") == width)
    start = [r["x"] for r in rows.orderBy(*order).limit(entries).collect()]  # as many rows as entries
    books = np.array(start, np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    schema = STATE.format(kind=kinds[id_col], label=kinds[label_col])
    state, before = rows, None
    for _ in range(rounds if start else 0):
        done, state = state, tables.put(state.mapInArrow(assigner(books, before), schema))
        tables.drop(done)
        before, books = books, updated(state, books)
    out = tables.put(state.mapInArrow(finisher(books, before), f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error bigint"))
    tables.drop(state)
    return out, books


def op13_vector_codes(spark, sf_dir):
    rows, books = code_vectors(table(spark, sf_dir, "embeddings"))
    totals = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = rows.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, width: int = 4) -> str:
    distance = " + ".join(f"(p.q[{i}] - c.q[{i}]) * (p.q[{i}] - c.q[{i}])" for i in range(1, width + 1))
    means = ", ".join(f"CAST(floor(sum(p.q[{i}])::DOUBLE / count(*)) AS BIGINT)" for i in range(1, width + 1))
    out = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM k),
p AS MATERIALIZED (SELECT r, part, v[part * {width} + 1 : part * {width} + {width}] AS q FROM r, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, q FROM p WHERE r <= {entries})"""
    for i in range(3):
        out += f""",
a{i} AS MATERIALIZED (SELECT p.r, p.part, min(struct_pack(d := {distance}, e := c.e)) AS m FROM p JOIN c{i} c USING (part) GROUP BY ALL)"""
        if i < 2:
            out += f""",
n{i} AS (SELECT p.part, a.m.e AS e, [{means}] AS q FROM p JOIN a{i} a USING (r, part) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(n.q, c.q) AS q FROM c{i} c LEFT JOIN n{i} n ON n.part = c.part AND n.e = c.e)"""
    return f"""{out},
o AS (SELECT r, string_agg(printf('%02x', a.m.e), '' ORDER BY part) AS code, CAST(sum(a.m.d) AS BIGINT) AS error FROM a2 a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, e)) FROM c2) AS codebooks_sha256 FROM r JOIN o USING (r)"""


ORACLE_SQL = _sql()
