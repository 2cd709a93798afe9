"""Repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of `length` bytes that covers it starts somewhere else too. Sorting all suffixes of a corpus
in one place can't work at scale, so strings meet by content first. Each string (window) has an anchor, the
least-hashed `gram` bytes in it; equal strings have equal anchors. Windows in a row with one anchor form a segment.

1. Blocks of texts send the distinct (anchor, segment) pairs that they hold, as hashes with counts, to the parts of
   the key space. A part sees whether an anchor occurs once (nothing repeats), always within the same segment (all of
   it repeats) or within different ones.
2. For the last kind the blocks send the segments' bytes. A part has two shards of them, builds the Burrows-Wheeler
   transform of each, and merges the two by interleave refinement: in round h every suffix goes, in the order found
   so far, to the place that the character before it asks for; the interleave is then right for the first h + 1
   characters, and suffixes that share these form a block. (Eight bytes are one character here, so that fewer rounds
   do.) After `length` bytes blocks are the intervals with a common prefix of that length; an interval with two or more occurrences repeats. No suffix is sorted anew.
   An anchor with more than `hot` segments in one block, or `crowd` in all, can't be gathered in one task: its
   windows are sent as 64-bit fingerprints and counted, exactly and without a group.
3. Blocks mark what repeats and remove it.

Texts are dealt by hash to blocks of about `block_bytes` and shuffled once; the three steps use that shuffle.

Defined results: a null or empty text has no bytes, nothing removed, and the digest of nothing. A text shorter than
`length` loses nothing. Repeated rows are texts of their own, so long enough ones lose all. Places within one text
count too. No rows give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, table, text_arrays
from .lm_score import pack, unpack

_RNG = np.random.default_rng(77)
_MULT = _RNG.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
UNIQUE, WHOLE, MIXED, HOT = 0, 1, 2, 3
#: Windows taken at once (work arrays stay in the cache), and bytes that one step of a transform takes.
STEP, WIDE = 1 << 17, 8


def sliding(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, without a copy."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), 0, (1,))


def fingerprints(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the strings of `length` (8 or more) bytes at some places."""
    words = sliding(data)
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j, at in enumerate([*range(0, length - 8, 8), length - 8]):
            out += mix64(words[starts + at]) * _MULT[j % 512]
    return mix64(out)


def hashed_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place: eight at first, then twice as many again and again."""
    x = sliding(data)
    out = (x ^ (x >> np.uint64(31))) * _MULT[0]
    have = 8
    while have < gram:
        step = min(have, gram - have)
        n = len(out) - step
        out = (out[:n] ^ (out[:n] >> np.uint64(29))) * _MULT[have % 512] + out[step:]
        have += step
    out = (out ^ (out >> np.uint64(32))) * _MULT[100]
    return out ^ (out >> np.uint64(29))


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """First window, number of windows, anchor and hash of each segment of a block of texts, in order."""
    w = length - gram + 1
    firsts, counts, anchors = [], [], []
    for s in range(0, max(0, len(data) - length + 1), STEP):
        sub = data[s : s + STEP + length - 1]
        n = len(sub) - length + 1
        m = len(sub) - gram + 1
        with np.errstate(over="ignore"):
            g = hashed_grams(sub, gram)
        # the least hash, then the first place, in each w places: running minima from both ends of blocks of w
        packed = (g & ~np.uint64((1 << 23) - 1)) | np.arange(m, dtype=np.uint64)
        full = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        full[:m] = packed
        grid = full.reshape(-1, w)
        ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(grid, axis=1).ravel()
        at = (np.minimum(ahead[:n], behind[w - 1 : w - 1 + n]) & np.uint64((1 << 23) - 1)).astype(np.int64)
        # windows within one text
        edges = offsets[1:-1] - s
        edges = edges[(edges > 0) & (edges < len(sub))]
        delta = np.zeros(n + 1, np.int32)
        np.add.at(delta, np.clip(edges - length + 1, 0, n), 1)
        np.add.at(delta, np.minimum(edges, n), -1)
        valid = np.flatnonzero(np.cumsum(delta[:-1]) == 0)
        if not len(valid):
            continue
        new = np.ones(len(valid), bool)
        new[1:] = (at[valid[1:]] != at[valid[:-1]]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        firsts.append(valid[first] + s)
        counts.append(np.diff(np.append(first, len(valid))))
        # least hashes crowd near zero: mixed, they spread over the parts, and different ones stay different
        anchors.append(mix64(g[at[valid[first]]]))
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first, count, anchor = (np.concatenate(x) for x in (firsts, counts, anchors))
    # two windows cover a segment: the first and the last
    with np.errstate(over="ignore"):
        own = mix64(fingerprints(data, first, length) * _MULT[101] + fingerprints(data, first + count - 1, length) * _MULT[102] + count.astype(np.uint64))
    return first, count, anchor, own


def distinct_pairs(anchor: np.ndarray, own: np.ndarray, hot: int):
    """Distinct (anchor, segment) in order, counts, and whether an anchor is hot in this block (then one row stands for it)."""
    order = np.lexsort((own, anchor))
    a, o = anchor[order], own[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    a, o, n = a[at], o[at], np.diff(np.append(at, len(order)))
    firsts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    kinds = np.diff(np.append(firsts, len(a)))
    is_hot = np.repeat(kinds > hot, kinds)
    keep = ~is_hot
    keep[firsts[kinds > hot]] = True
    return a[keep], np.where(is_hot, np.uint64(0), o)[keep], np.where(is_hot, 2, n)[keep].astype(np.uint32), is_hot[keep].astype(np.uint8)


def cuts_of(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def by_part(keys: np.ndarray, parts: int):
    """Ranges of the parts in sorted keys."""
    bounds = np.concatenate(([0], np.searchsorted(keys, cuts_of(parts)), [len(keys)])).astype(np.int64)
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def in_order(block: pa.Table) -> pa.Table:
    """Rows by their hash: a shuffle may bring them in another order each time, and segments are cut by place."""
    return block.sort_by("h")


def ask_first(parts: int, length: int, gram: int, hot: int):
    def ask(block: pa.Table) -> pa.Table:
        data, offsets = text_arrays(in_order(block).column("text"))
        _, _, anchor, own = segments(data, offsets, length, gram)
        cols = distinct_pairs(anchor, own, hot)
        ranges = by_part(cols[0], parts)
        b = block.column("block")[0].as_py()
        return pa.table(
            [pa.array(np.arange(parts), pa.int32()), pa.array([b] * parts, pa.int32()), *(pa.array([pack(c[x:y]) for x, y in ranges], pa.binary()) for c in cols)],
            names=["part", "block", "anchors", "owns", "counts", "hots"],
        )

    return ask


def answer_first(crowd: int):
    def answer(part: pa.Table) -> pa.Table:
        read = lambda c, t: [unpack(x.as_buffer(), t) for x in part.column(c)]
        anchors, owns, counts, hots = read("anchors", np.uint64), read("owns", np.uint64), read("counts", np.uint32), read("hots", np.uint8)
        edges = np.cumsum([0, *map(len, anchors)])
        a, o, n, h = (np.concatenate(x) for x in (anchors, owns, counts, hots))
        codes = np.zeros(len(a), np.uint8)
        if len(a):
            order = np.lexsort((o, a))
            sa, so = a[order], o[order]
            first = np.concatenate(([True], sa[1:] != sa[:-1]))
            fresh = first.copy()
            fresh[1:] |= so[1:] != so[:-1]
            group = np.cumsum(first) - 1
            total = np.bincount(group, weights=n[order])
            kinds = np.bincount(group, weights=fresh)
            is_hot = (np.bincount(group, weights=h[order]) > 0) | (kinds > crowd)
            code = np.where(total < 2, UNIQUE, np.where(is_hot, HOT, np.where(kinds == 1, WHOLE, MIXED)))
            codes[order] = code[group]
        blobs = [codes[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([part.column("block"), part.column("part"), pa.array([1] * len(part), pa.int32()), pa.array(blobs, pa.binary()), pa.array([b""] * len(part), pa.binary())], names=["block", "part", "kind", "codes", "marks"])

    return answer


def coded(block: pa.Table, answers: pa.Table, length: int, gram: int, hot: int):
    """The block's texts and segments, with what the first answers say of each segment."""
    data, offsets = text_arrays(block.column("text"))
    first, count, anchor, own = segments(data, offsets, length, gram)
    asked = distinct_pairs(anchor, own, hot)[0]
    codes = np.frombuffer(b"".join(answers.column("codes").to_pylist()), np.uint8)
    code = codes[np.searchsorted(asked, anchor)] if len(anchor) else np.zeros(0, np.uint8)
    return data, offsets, first, count, anchor, own, code


def wanted(data, first, count, anchor, own, code, length):
    """Of a block: its mixed segments (order of the distinct ones, and which one each is) and its hot windows."""
    mixed = np.flatnonzero(code == MIXED)
    order = mixed[np.lexsort((own[mixed], anchor[mixed]))]
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (own[order][1:] != own[order][:-1])
    chosen = order[new]
    which = np.cumsum(new) - 1
    crowded = np.flatnonzero(code == HOT)
    n = count[crowded]
    windows = np.repeat(first[crowded], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    prints, at = np.unique(fingerprints(data, windows, length), return_inverse=True)
    return chosen, order, which, prints, at, windows


def ask_second(parts: int, length: int, gram: int, hot: int):
    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers, block = answers.sort_by("part"), in_order(block)
        data, _, first, count, anchor, own, code = coded(block, answers, length, gram, hot)
        chosen, order, which, prints, at, _ = wanted(data, first, count, anchor, own, code, length)
        times = np.bincount(which, minlength=len(chosen)).astype(np.uint32)
        sizes = (count[chosen] + length - 1).astype(np.uint32)
        segs, fps = by_part(anchor[chosen], parts), by_part(prints, parts)
        shown = np.bincount(at, minlength=len(prints)).astype(np.uint32)
        rows = []
        for i in range(parts):
            x, y = segs[i]
            u, v = fps[i]
            body = b"".join(data[first[c] : first[c] + z].tobytes() for c, z in zip(chosen[x:y].tolist(), sizes[x:y].tolist(), strict=True))
            rows.append((pack(anchor[chosen][x:y]), pack(sizes[x:y]), pack(times[x:y]), body, pack(prints[u:v]), pack(shown[u:v])))
        b = block.column("block")[0].as_py()
        return pa.table([pa.array(np.arange(parts), pa.int32()), pa.array([b] * parts, pa.int32()), *(pa.array([r[i] for r in rows], pa.large_binary()).cast(pa.binary()) for i in range(6))], names=["part", "block", "anchors", "sizes", "times", "body", "prints", "shown"])

    return ask


def order_of(symbols: np.ndarray) -> np.ndarray:
    """Stable order of small numbers, by one or two passes over 16 bits."""
    low = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if not len(symbols) or int(symbols.max()) < 1 << 16:
        return low
    return low[np.argsort((symbols[low] >> 16).astype(np.uint16), kind="stable")]


class Shard:
    """Burrows-Wheeler transform of some strings, WIDE bytes to a symbol.

    A suffix is read in symbols of WIDE bytes; what has fewer bytes left is an end, and ends are all different and
    come first. `before` has, in the order of the suffixes, the symbol before each (0 where the string begins less than
    WIDE bytes before); `places` has where each suffix starts.
    """

    def __init__(self, texts: list[bytes], symbols: np.ndarray) -> None:
        lengths = np.array([len(t) + 1 for t in texts], np.int64)  # the empty suffix is one, too
        stops = np.cumsum(lengths)
        n = int(stops[-1]) if len(texts) else 0
        left = np.repeat(stops, lengths) - 1 - np.arange(n)
        ends = left < WIDE
        self.ends = int(ends.sum())
        body = np.frombuffer(b"\0".join(texts) + bytes(WIDE + 1), np.uint8)
        words = np.ndarray((n,), "<u8", body, 0, (1,))
        symbol = np.searchsorted(symbols, words).astype(np.int64) + 1
        rank = symbol + self.ends
        rank[ends] = np.arange(self.ends)
        order, h = np.argsort(rank, kind="stable"), WIDE
        longest = int(lengths.max()) if len(texts) else 0
        while h < longest:
            key = rank * (n + len(symbols) + 2) + rank[np.minimum(np.arange(n) + h, n - 1)]
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
            h *= 2
            if rank[order[-1]] == n - 1:
                break
        begins = np.arange(n) - np.repeat(stops - lengths, lengths)
        before = np.concatenate((np.zeros(WIDE, np.int64), symbol[:-WIDE])) if n > WIDE else np.zeros(n, np.int64)
        before[begins < WIDE] = 0
        self.before, self.places = before[order].astype(np.uint32), order


def merge_transforms(left: list[bytes], right: list[bytes], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement of two shards' transforms; per suffix place (left's strings, then right's): its interval's number.

    Suffixes share an interval if they share their first `rounds` symbols.
    """
    body = b"\0".join((*left, *right)) + bytes(WIDE + 1)
    symbols = np.unique(np.ndarray((len(body) - WIDE + 1,), "<u8", np.frombuffer(body, np.uint8), 0, (1,)))
    a, b = Shard(left, symbols), Shard(right, symbols)
    n, m, nl = len(a.before) + len(b.before), a.ends + b.ends, len(a.before)
    both = np.concatenate((a.before, b.before))
    # ends come first; to begin with, nothing is told apart
    side = np.zeros(n, bool)
    side[a.ends : m] = True
    side[m + nl - a.ends :] = True
    block = np.zeros(n, np.int32)
    spot = np.empty(n, np.int64)
    edge = np.ones(n - m, bool)

    def place() -> None:
        spot[~side] = np.arange(nl)
        spot[side] = np.arange(nl, n)

    for _ in range(rounds):
        place()
        symbol = both[spot]
        moved = np.flatnonzero(symbol)
        order = moved[order_of(symbol[moved])]
        c, k = symbol[order], block[order]
        side[m:] = side[order]
        edge[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
        block[:m] = np.arange(m)
        block[m:] = m - 1 + np.cumsum(edge, dtype=np.int32)
    place()
    where = np.concatenate((a.places, b.places + nl))
    out = np.empty(n, np.int64)
    out[where[spot]] = block
    return out, np.concatenate(([0], np.cumsum([len(t) + 1 for t in (*left, *right)])))


def repeated_windows(texts: list[bytes], times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each of some distinct strings, which of its windows occur twice or more among all, counted by `times`."""
    if len(texts) < 2:
        return [np.full(len(t) - length + 1, n > 1) for t, n in zip(texts, times, strict=True)]
    half = len(texts) // 2
    interval, starts = merge_transforms(texts[:half], texts[half:], length // WIDE)
    sizes = np.array([len(t) - length + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    places = np.repeat(starts[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = interval[places]
    if length % WIDE:  # the symbols stop short of the length: those of the last bytes tell the rest apart
        _, at = np.unique(at * len(interval) + interval[places + length % WIDE], return_inverse=True)
    held = np.bincount(at, weights=times[owner])
    return np.split(held[at] > 1, np.cumsum(sizes)[:-1])


def answer_second(length: int, batch_bytes: int = 1 << 18):
    def answer(part: pa.Table) -> pa.Table:
        read = lambda c, t: [unpack(x.as_buffer(), t) for x in part.column(c)]
        anchors, sizes, times, prints, shown = read("anchors", np.uint64), read("sizes", np.uint32), read("times", np.uint32), read("prints", np.uint64), read("shown", np.uint32)
        n = len(part)
        # distinct segments of each anchor over all blocks
        ids: dict[tuple[int, bytes], int] = {}
        total: list[int] = []
        mine: list[list[int]] = []
        for i in range(n):
            body, at, own = part.column("body")[i].as_py(), 0, []
            for a, z, t in zip(anchors[i].tolist(), sizes[i].tolist(), times[i].tolist(), strict=True):
                key = (a, body[at : at + z])
                at += z
                k = ids.setdefault(key, len(ids))
                if k == len(total):
                    total.append(0)
                total[k] += t
                own.append(k)
            mine.append(own)
        keys = sorted(ids)
        flags: list = [None] * len(keys)
        lo = 0
        while lo < len(keys):  # whole anchors together, some megabytes at a time
            hi, held = lo, 0
            while hi < len(keys) and (held < batch_bytes or keys[hi][0] == keys[hi - 1][0]):
                held += len(keys[hi][1])
                hi += 1
            chosen = [ids[k] for k in keys[lo:hi]]
            for k, f in zip(chosen, repeated_windows([k[1] for k in keys[lo:hi]], np.array([total[k] for k in chosen]), length), strict=True):
                flags[k] = f
            lo = hi
        codes = [np.packbits(np.concatenate([flags[k] for k in own])).tobytes() if own else b"" for own in mine]
        every = np.concatenate(prints)
        marks = [b""] * n
        if len(every):
            values, at = np.unique(every, return_inverse=True)
            twice = (np.bincount(at, weights=np.concatenate(shown)) > 1)[at]
            edges = np.cumsum([0, *map(len, prints)])
            marks = [np.packbits(twice[x:y]).tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table([part.column("block"), part.column("part"), pa.array([2] * n, pa.int32()), pa.array(codes, pa.binary()), pa.array(marks, pa.binary())], names=["block", "part", "kind", "codes", "marks"])

    return answer


def remover(parts: int, length: int, gram: int, hot: int, schema: pa.Schema):
    import pyarrow.compute as pc

    def remove(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers, block = answers.sort_by([("kind", "ascending"), ("part", "ascending")]), in_order(block)
        one, two = (answers.filter(pc.equal(answers.column("kind"), k)) for k in (1, 2))
        data, offsets, first, count, anchor, own, code = coded(block, one, length, gram, hot)
        chosen, order, which, prints, at, windows = wanted(data, first, count, anchor, own, code, length)
        change = np.zeros(len(data) + 1, np.int32)

        def cover(starts):
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)

        whole = code == WHOLE
        np.add.at(change, first[whole], 1)
        np.add.at(change, first[whole] + count[whole] - 1 + length, -1)
        if len(chosen):
            bits = [np.unpackbits(np.frombuffer(c, np.uint8))[: int(count[chosen[x:y]].sum())] for c, (x, y) in zip(two.column("codes").to_pylist(), by_part(anchor[chosen], parts), strict=True)]
            bits = np.concatenate(bits).astype(bool)
            begin = np.cumsum(count[chosen]) - count[chosen]
            n = count[order]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = bits[np.repeat(begin[which], n) + inner]
            cover((np.repeat(first[order], n) + inner)[hit])
        if len(prints):
            bits = np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8))[: y - x] for c, (x, y) in zip(two.column("marks").to_pylist(), by_part(prints, parts), strict=True)]).astype(bool)
            cover(windows[bits[at]])
        gone = np.cumsum(change[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[inner] = gone[inner]
        spans = np.concatenate(([0], np.cumsum(begins)))
        digests = [hashlib.sha256(data[x:y][~gone[x:y]].tobytes()).hexdigest() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        cols = [block.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()), pa.array(spans[offsets[1:]] - spans[offsets[:-1]], pa.int64()), pa.array(digests, pa.string())]
        return pa.table(cols, schema=schema)

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 64, hot: int = 16, crowd: int = 4096, block_bytes: int = 16 << 20, part_bytes: int = 16 << 20) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay)."""
    from pyspark.sql.pandas.types import to_arrow_type

    if not 8 <= gram <= length:
        raise ValueError("gram must be between 8 and length")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")) + 8)).first()[0] or 0
    blocks, parts = max(1, math.ceil(total / block_bytes)), max(1, math.ceil(total / part_bytes))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = slim.withColumn("h", F.xxhash64("id", "text")).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int")).repartition(2 * blocks, "block")
    reply = "block int, part int, kind int, codes binary, marks binary"
    asked = dealt.groupBy("block").applyInArrow(ask_first(parts, length, gram, hot), "part int, block int, anchors binary, owns binary, counts binary, hots binary")
    asked = asked.repartition(2 * parts, "part")  # a number given is kept: parts stay apart
    one = asked.groupBy("part").applyInArrow(answer_first(crowd), reply)
    again = dealt.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(ask_second(parts, length, gram, hot), "part int, block int, anchors binary, sizes binary, times binary, body binary, prints binary, shown binary")
    two = again.repartition(2 * parts, "part").groupBy("part").applyInArrow(answer_second(length), reply)
    schema = pa.schema([("id", to_arrow_type(slim.schema["id"].dataType)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    out = dealt.groupBy("block").cogroup(one.unionByName(two).groupBy("block")).applyInArrow(remover(parts, length, gram, hot, schema), f"id {dict(docs.dtypes)[id_col]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
