"""Near-duplicate documents by SimHash fingerprints and a byte-position inverted index.

A fingerprint has 64 bits, a bit for each over half of the shingles' hashes. Two fingerprints that differ in at most `bits`
bits differ in at most that many of their 8 bytes, so at least 8 - `bits` positions hold the same byte: the guaranteed
minimum of the count filter. The index lists fingerprints by positions and their bytes. A list of a single position would hold a
256th of all texts, so lists are keyed by two positions at once: the 8 positions are cut into one group less than the minimum, and by
the pigeonhole principle two of any such minimum of shared positions lie in one group. For each pair in a list the shared
positional bytes are tallied, pairs that reach the minimum are kept, and these are verified on all bits.

Equal fingerprints are one entry, however many documents have them. A list gives out a star of each group of entries that its
links join, never its pairs. A list of more than `cell` entries isn't compared: its entries go on to lists of one position more, as
long as the minimum says that a further shared position must exist, those with one component only being dropped first. Lists
that are large with all positions of the minimum shared are compared in chunks, each pair of chunks in a cell of its own.
So every pair within `bits` meets in some cell, and no cell has more than about twice `cell` entries.

Defined results: a null text is empty; texts without words have fingerprint zero, linked like any other. Null ids are judged
too, but never name a component, unless none of its rows has an id: then component_id is null. Repeated rows are rows of
the same fingerprint. No rows give no rows. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, Tables, pieces, scan_tasks, table, text_arrays, word_spans
from .near_dup import components, relabel

#: Shingles whose bits are summed at once.
AT_ONCE = 1 << 16
#: Lists up to this many entries are compared side by side with others, larger ones by themselves.
FEW = 32


def shingle_texts(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space each, and begin, end and row of each shingle in them; short rows are one shingle."""
    starts, ends, row = word_spans(data, offsets)
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int((lengths + 1).sum()), 32, np.uint8)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(at, lengths) + within] = data[np.repeat(starts, lengths) + within]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    full = np.flatnonzero(row[words - 1 :] == row[: len(row) - words + 1]) if len(row) >= words else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    begin = np.concatenate((at[full], at[first[short]]))
    last = np.concatenate((full + words - 1, first[short] + counts[short] - 1))
    owner = np.concatenate((row[full], short))
    order = np.argsort(owner, kind="stable")
    return out.tobytes(), begin[order], (at[last] + lengths[last])[order], owner[order]


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each row of lower-cased UTF-8 bytes."""
    text, begin, end, owner = shingle_texts(data, offsets, words)
    n = len(offsets) - 1
    ones, hashed = np.zeros((n, 64), np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(begin), AT_ONCE):
        b, e, own = begin[lo : lo + AT_ONCE].tolist(), end[lo : lo + AT_ONCE].tolist(), owner[lo : lo + AT_ONCE]
        h = np.fromiter((hashed(text[i:j], seed) for i, j in zip(b, e, strict=True)), "<u8", len(b))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    most = ones * 2 > np.bincount(owner, minlength=n)[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def fingerprinter(words: int, seed: int):
    def work(batches):
        for batch in batches:
            data, offsets = text_arrays(batch.column("text"))
            for lo, hi in pieces(offsets):
                own = fingerprints(TO_LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], words, seed)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(own.view(np.int64))], ["id", "f"])

    return work


def position_sets(bits: int) -> list[list[tuple[int, ...]]]:
    """By level: the sets of byte positions that lists are keyed by, the first two positions in order, then ascending.

    The first level's pairs cover every choice of the guaranteed minimum of positions. A set's children add a later one of the
    other positions, where enough of these are left for the minimum.
    """
    least = 8 - bits
    if not 2 <= least <= 8:
        raise ValueError("fingerprints may differ in 0 to 6 bits")
    groups = [[p for p in range(8) if p % (least - 1) == g] for g in range(least - 1)]
    levels = [[pair for group in groups for pair in combinations(group, 2)]]
    while len(levels[-1][0]) < min(least, 4):
        grown = []
        for s in levels[-1]:
            rest = [p for p in range(8) if p not in s[:2]]
            after = rest.index(s[-1]) + 1 if len(s) > 2 else 0
            missing = least - len(s)
            grown += [(*s, p) for p in rest[after : len(rest) - missing + 1]]
        levels.append(grown)
    return levels


def list_key(s: tuple[int, ...], no: int) -> Column:
    """A list's key: the number of its set of positions, then their bytes."""
    key = F.lit(no).cast("bigint")
    for p in s:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("f", 8 * p).bitwiseAND(F.lit(255).cast("bigint")))
    return key


def groups_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each entry's group, by the links a-b of n entries."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    while (label[label] != label).any():
        label = label[label]
    return label


_BYTES = np.uint64(0x0101010101010101)


def close(x: np.ndarray, bits: int) -> np.ndarray:
    """Which differences of fingerprints pass: the tally of equal bytes first, then all bits of those that reach the minimum."""
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    tally = 8 - np.bitwise_count(y & _BYTES)
    out = tally >= 8 - bits
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def links_within(f: np.ndarray, key: np.ndarray, label: np.ndarray, side: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different labels in lists, sorted by key. side: 0 or 1 where only entries of different sides are to meet, else 2."""
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(edges)
    out_a, out_b = [], []
    many = np.repeat(sizes > FEW, sizes)
    rows, d = np.flatnonzero(~many), 1
    while len(rows):  # entry and the d-th after it
        rows = rows[rows + d < len(key)]
        rows = rows[key[rows] == key[rows + d]]
        a, b = rows, rows + d
        apart = (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == 2))
        a, b = a[apart], b[apart]
        good = close(f[a] ^ f[b], bits)
        out_a.append(a[good])
        out_b.append(b[good])
        d += 1
    for lo, n in zip(edges[:-1][sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        own, tags, sides = f[lo : lo + n], label[lo : lo + n], side[lo : lo + n]
        found = []
        for i in range(0, n, 256):
            x = own[i : i + 256, None] ^ own[None, i:]
            a, b = np.nonzero((tags[i : i + 256, None] != tags[None, i:]) & ((sides[i : i + 256, None] != sides[None, i:]) | (sides[None, i:] == 2)))
            keep = b > a
            a, b = a[keep], b[keep]
            good = close(x[a, b], bits)
            found.append((a[good] + i, b[good] + i))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        star = groups_of(a, b, n)  # a large list's links are cut down before the next list
        spoke = np.flatnonzero(star != np.arange(n))
        out_a.append(star[spoke] + lo)
        out_b.append(spoke + lo)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def linker(bits: int):
    """Stars of linked entries from rows sorted by key; a list may go over several batches."""

    def work(batches):
        held: list[dict] = []

        def flush(rows):
            if not len(rows["key"]):
                return
            a, b = links_within(rows["f"].view(np.uint64), rows["key"], rows["label"], rows["side"], bits)
            star = groups_of(a, b, len(rows["key"]))
            spoke = np.flatnonzero(star != np.arange(len(star)))
            if len(spoke):
                yield pa.RecordBatch.from_arrays([pa.array(rows["label"][star[spoke]]), pa.array(rows["label"][spoke])], ["a", "b"])

        def joined():
            return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "f", "label", "side")})
            if held[-1]["key"][-1] != held[0]["key"][0]:  # the last list may go on
                rows = joined()
                cut = int(np.searchsorted(rows["key"], rows["key"][-1], "left"))
                yield from flush({c: v[:cut] for c, v in rows.items()})
                held = [{c: v[cut:] for c, v in rows.items()}]
        if held:
            yield from flush(joined())

    return work


def linked(rows: DataFrame, bits: int) -> DataFrame:
    """Labels that the links of some lists join. rows: key, f, label, side."""
    dealt = rows.repartition(scan_tasks(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(linker(bits), "a bigint, b bigint").distinct()


def link_fingerprints(entries: DataFrame, tables: Tables, bits: int = 4, cell: int = 2048) -> DataFrame:
    """k and the least fingerprint c of its component, for each of some distinct fingerprints f that has a link."""
    levels = position_sets(bits)
    labels = entries.select("f", F.col("f").alias("label"))
    keys = F.array(*(list_key(s, no) for no, s in enumerate(levels[0])))
    rows = tables.put(labels.select("f", "label", F.explode(keys).alias("key")))
    found: list[DataFrame] = []
    for depth, sets in enumerate(levels):
        held = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("size > 1 AND low <> high")
        small = rows.join(held.where(F.col("size") <= cell).select("key"), "key").withColumn("side", F.lit(2))
        found.append(tables.put(linked(small.select("key", "f", "label", "side"), bits)))
        large = tables.put(rows.join(held.where(F.col("size") > cell).select("key", "size"), "key"))
        tables.drop(rows)
        if not large.limit(1).count():
            return _all(found, tables)
        comps = _all(found, tables)
        large = relabel(large, comps)
        if depth + 1 < len(levels):
            after = [(no, s, sets.index(s[:-1])) for no, s in enumerate(levels[depth + 1])]
            parent = F.shiftright("key", 8 * len(sets[0])).cast("int")
            grown = F.filter(F.array(*(F.when(parent == p, list_key(s, no)) for no, s, p in after)), lambda k: k.isNotNull())
            rows = tables.put(large.select("f", "label", F.explode(grown).alias("key")).distinct())
    # Large lists with all positions of the minimum: an entry meets its own chunk's others, and each other chunk once.
    held = large.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    chunks = large.drop("size").join(held.select("key", F.ceil(F.col("size") / cell).cast("int").alias("chunks")), "key")
    chunks = chunks.withColumn("own", F.pmod(F.xxhash64("f"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    found.append(tables.put(linked(chunks.select(pair.alias("key"), "f", "label", side.alias("side")), bits)))
    return _all(found, tables)


def _all(found: list[DataFrame], tables: Tables) -> DataFrame:
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return components(edges, tables)


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4, seed: int = 42, cell: int = 2048) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id (the smallest id reachable by links)."""
    tables = Tables(docs.sparkSession, "simhash")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = tables.put(slim.mapInArrow(fingerprinter(words, seed), f"id {dict(docs.dtypes)[id_col]}, f bigint"))
    entries = tables.put(marked.groupBy("f").agg(F.min("id").alias("least")))
    member = relabel(entries.withColumn("label", F.col("f")), link_fingerprints(entries, tables, bits, cell))
    smallest = member.groupBy("label").agg(F.min("least").alias("component_id"))
    member = tables.put(member.join(smallest, "label").select("f", "component_id"))
    out = marked.join(member, "f")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir):
    return simhash_duplicates(table(spark, sf_dir, "documents"))
