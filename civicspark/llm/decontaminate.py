"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalized (A-Z lower-cased, runs of anything but letters, digits and bytes above ASCII become one
space). An item of m bytes that occurs in a document with at most k edits shares m + 1 - q (k + 1) q-grams with
it, all of them on diagonals (place in the document less place in the item) within 2k of each other. Shared q-grams
are counted in overlapping bands of diagonals, three bins of k + 1 each; bands that reach the bound are kept,
and a banded alignment of the whole item decides. No place is skipped, no frequent q-gram left out.

The benchmark is the stated query set: it goes to the tasks in slices of at most `slice_bytes`, so what is
broadcast has a fixed bound however large the benchmark is. Documents are never shuffled.

Defined results: null and empty texts or items match nothing; an item that normalizes to fewer than q bytes is
too short to tell and matches nothing. Repeated documents give a row each; items with equal ids are one item each
time they occur. Of several places of an item in a document, the first that aligns is given. Places are code
points of the document's text. Only the id and text columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, pieces, table, text_arrays

KEEP = np.zeros(256, bool)
KEEP[48:58] = KEEP[97:123] = True
KEEP[128:] = True
HASH = np.uint64(0x9E3779B97F4A7C15)
BITS = 24


def normalize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalized bytes, their row offsets, and where each came from. Rows neither start nor end with a space."""
    low = TO_LOWER[data]
    solid = KEEP[low]
    gap = np.zeros(len(data), bool)  # the first byte of a gap stands for it
    gap[1:] = ~solid[1:] & solid[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    gap[starts] = False
    kept = np.flatnonzero(solid | gap)
    out = np.where(solid[kept], low[kept], np.uint8(32))
    rows = np.searchsorted(kept, offsets)
    trailing = np.zeros(len(kept), bool)
    filled = rows[1:] > rows[:-1]
    last = rows[1:][filled] - 1
    trailing[last] = out[last] == 32
    if trailing.any():
        kept, out = kept[~trailing], out[~trailing]
        rows = rows - np.concatenate(([0], np.cumsum(trailing)))[rows]
    return out, rows, kept


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit key of each q bytes: the last 8 exactly, mixed with the first 8 (8 <= q <= 16)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    with np.errstate(over="ignore"):
        x = (words[:n] * np.uint64(0xBF58476D1CE4E5B9)) ^ (words[q - 8 : q - 8 + n] * np.uint64(0x94D049BB133111EB) + (words[:n] >> np.uint64(29)))
        return x * HASH


class Index:
    """The q-grams of one slice of the benchmark."""

    def __init__(self, ids: list, texts: list[str], q: int, budget: float) -> None:
        data, offsets = text_arrays(pa.array(texts, pa.string()))
        data, offsets, _ = normalize(data, offsets)
        self.q, self.items, self.ids, keys, item, at = q, [], [], [], [], []
        for i in range(len(ids)):
            own = data[offsets[i] : offsets[i + 1]]
            if len(own) < q:
                continue
            k = min(int(budget * len(own)), (len(own) - q) // q)
            g = grams(own, q)
            keys.append(g)
            item.append(np.full(len(g), len(self.items), np.int64))
            at.append(np.arange(len(g), dtype=np.int64))
            self.items.append((own.copy(), k))
            self.ids.append(ids[i])
        self.m = np.array([len(x) for x, _ in self.items], np.int64)
        self.k = np.array([k for _, k in self.items], np.int64)
        self.least = self.m + 1 - q * (self.k + 1)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.start = np.append(first, len(keys))
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, np.int64)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.keys >> np.uint64(64 - BITS)] = True

    def candidates(self, data: np.ndarray, rows: np.ndarray):
        """(row, item, first bin) of the bands that reach the lemma's bound, in order."""
        keys = grams(data, self.q)
        places = np.flatnonzero(self.bitmap[keys >> np.uint64(64 - BITS)])
        if not len(places) or not len(self.keys):
            return []
        at = np.searchsorted(self.keys, keys[places])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[places]
        places, at = places[hit], at[hit]
        row = np.searchsorted(rows, places, "right") - 1
        inside = places + self.q <= rows[row + 1]
        places, at, row = places[inside], at[inside], row[inside]
        n = self.start[at + 1] - self.start[at]
        if not n.sum():
            return []
        # pairs of places, a bounded number at a time; counts of their bands are added up
        wide = int((rows[1:] - rows[:-1]).max() + 2 * self.m.max()) + 8
        code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo, hi in _chunks(n):
            m = n[lo:hi]
            which = np.repeat(self.start[at[lo:hi]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            item, own = self.item[which], np.repeat(row[lo:hi], m)
            diagonal = np.repeat(places[lo:hi], m) - rows[own] - self.at[which]
            band = (diagonal + self.m[item]) // (self.k[item] + 1)
            new, times = np.unique((own * len(self.items) + item) * wide + band, return_counts=True)
            code, where = np.unique(np.concatenate((code, new)), return_inverse=True)
            count = np.bincount(where, weights=np.concatenate((count, times)), minlength=len(code)).astype(np.int64)
        total = count.copy()
        for step in (1, 2):
            nxt = np.searchsorted(code, code + step)
            nxt[nxt == len(code)] = 0
            total += np.where(code[nxt] == code + step, count[nxt], 0)
        good = total >= self.least[(code // wide) % len(self.items)]
        return [(int(c // wide // len(self.items)), int(c // wide % len(self.items)), int(c % wide)) for c in code[good]]


def _chunks(n: np.ndarray, most: int = 1 << 21):
    """Ranges of places with `most` pairs or so in all; one place at least, which has no more pairs than the slice has q-grams."""
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def banded(item: np.ndarray, text: np.ndarray, first: int, last: int, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """Edits and end of the best alignment of the whole item to a stretch of text that begins in [first, last] - or None if over `most`.

    Free ends in the text; diagonals from first - most to last + most only. anchored: the stretch begins at `first`; of equally good ends the nearest.
    """
    lo = first - most
    width = last - first + 2 * most + 1
    far = len(item) + len(text) + 1
    padded = np.full(len(item) + width + 1, 300, np.int16)
    src = np.arange(lo, lo + len(padded))
    ok = (src >= 0) & (src < len(text))
    padded[ok] = text[src[ok]]
    steps = np.arange(width)
    row = np.where((steps + lo >= 0) & (steps + lo <= len(text)), np.where(steps >= most, steps - most, far) if anchored else 0, far)
    for i in range(1, len(item) + 1):
        end = steps + lo + i
        new = np.minimum(row + (padded[i - 1 : i - 1 + width] != item[i - 1]), np.append(row[1:], far) + 1)
        new[(end < 0) | (end > len(text))] = far
        row = np.minimum(np.minimum.accumulate(new - steps) + steps, far)
        if row.min() > most:
            return None
    at = int(row.argmin())
    return int(row[at]), at + lo + len(item)


def aligned(item: np.ndarray, text: np.ndarray, first: int, last: int, most: int) -> tuple[int, int, int] | None:
    """Edits, begin and end of the best alignment. The begin is that of an alignment read backwards from the end."""
    found = banded(item, text, first, last, most)
    if found is None or found[0] > most:
        return None
    edits, end = found
    _, back = banded(item[::-1], text[:end][::-1], 0, 0, most, anchored=True)
    return edits, end - back, end


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 12, budget: float = 0.05, slice_bytes: int = 2 << 20) -> DataFrame:
    """A row for each document and item that it holds: id, item, edits, first and end (code points).

    budget: edits allowed as a share of the item's normalized bytes.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = math.ceil(total / slice_bytes * 1.5) if total > slice_bytes else 1
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    schema = f"id {kinds[0]}, item {kinds[1]}, edits int, first bigint, end bigint"
    out = None
    for s in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == s)
        own = part.orderBy("item", "text").collect()  # slice_bytes or so
        index = spark.sparkContext.broadcast(Index([r["item"] for r in own], [r["text"] for r in own], q, budget))
        found = slim.mapInArrow(_scanner(index, schema_of(slim, items)), schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", "first", "end")


def schema_of(slim: DataFrame, items: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("id", to_arrow_type(slim.schema["id"].dataType)), ("item", to_arrow_type(items.schema["item"].dataType)), ("edits", pa.int32()), ("first", pa.int64()), ("end", pa.int64())])


def _scanner(index, schema):
    def scan(batches):
        ix = index.value
        for batch in batches:
            data, offsets = text_arrays(batch.column("text"))
            ids, rows_out = batch.column("id"), []
            for lo, hi in pieces(offsets):
                raw, rel = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                norm, rows, origin = normalize(raw, rel)
                done: set[tuple[int, int]] = set()
                for row, item, band in ix.candidates(norm, rows):
                    if (row, item) in done:
                        continue
                    want, k = ix.items[item]
                    own = norm[rows[row] : rows[row + 1]]
                    d = band * (k + 1) - len(want)
                    from_, to = max(0, d - k), min(len(own), d + 3 * (k + 1) + k + len(want))
                    exact = own[from_:to].tobytes().find(want.tobytes())
                    got = (0, from_ + exact, from_ + exact + len(want)) if exact >= 0 else aligned(want, own, d, d + 3 * (k + 1), k)
                    if got is None:
                        continue
                    done.add((row, item))
                    edits, first, end = got
                    where = origin[rows[row] + first], origin[rows[row] + max(end - 1, 0)] + 1
                    text = raw[rel[row] : rel[row + 1]]
                    a, b = (int(((text[: w - rel[row]] & 0xC0) != 0x80).sum()) for w in where)
                    rows_out.append((lo + row, ix.ids[item], edits, a, b))
            at = pa.array([r[0] for r in rows_out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), *(pa.array([r[i] for r in rows_out], schema.field(i).type) for i in (1, 2, 3, 4))], schema=schema)

    return scan


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with. A null id is kept only if no null id leaks."""
    leaks = find_leaks(docs, benchmark, id_col, **options).select(F.col(id_col).alias("_leak")).distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["_leak"]), "left_anti")


def op10_leaks(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
