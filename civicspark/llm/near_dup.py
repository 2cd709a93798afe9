"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Equal sets become one class first, however many copies there
are. A class carries `COORDS` minwise values of 16 bits. In each of some independent trees a node is a set of
classes that share chosen values: a node chooses two of the coordinates by its own hash, and a class goes to the
child that its value names. Nodes of at most `small` classes are compared exhaustively by their minwise values, and
pairs that may reach the threshold are confirmed on the full sets. `missed` gives the chance that a pair at the
threshold shares no node, over the binomial number of values that the pair has in common; `recall` sets the trees.

What is linked already needs no second look: classes carry the label of their component, and a node with one label
is dropped. Leaders make that true of large groups of near copies early: in short paths, all classes of a node
are held against the one with most company.

Nodes that are still large after `depth` levels hold crowds: many texts that are alike, but not linked. Their leaders
are met once more, by many values; then their classes go on in narrow trees, on values that chose nothing before: a tree
takes as many at once as the largest node needs to become small, and there are as many trees as `recall` asks for at that
length. So a class meets about `small` others in a tree, however large its crowd is. A narrow node that is large all the same
(sets that agree in many values and still aren't linked) is compared in cells of a bounded number of classes, so no
pair is left out.

Candidates between different labels are confirmed at the end, so the many links within a group cost nothing. In a crowd most pairs
aren't links though they look alike, so there classes carry 32 bits of each shingle, and pairs are tested on these where they meet.

Components come from rounds of smallest-neighbour messages with pointer jumps. All steps are tables in the
shared folder; tasks hold a batch or a chunk, never a group. Only counts and smallest keys are taken per node.

Defined results: a null or empty text, or one without words, has the empty set and is linked with nothing. With
fewer words than a shingle the whole sequence is one shingle. Repeated rows get a row each, with the same
component; so do two texts under one id, whose sets are told apart. A null id can't be a representative: its component is the smallest id of
its class or component, else null, and it is kept only in the latter case. Only the id and text columns are read, so others may have any name.
Equal sets are told by a 64-bit sum of mixed shingle keys, and shingles by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, Tables, binary_rows, mix64, pieces, scan_tasks, span_hashes, table, text_arrays, window_hashes, word_spans

_RNG = np.random.default_rng(11)
#: Minwise values that paths are chosen from: of all classes (16 bits each), and of those in crowds (8 bits).
COORDS, WIDE = 32, 1056
_XOR = _RNG.integers(0, 2**32, WIDE, dtype=np.uint32)
_MULT = _RNG.integers(0, 2**31, WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Classes of a crowd that meet in one cell.
CHUNK = 128
#: Leaders' values that go to all tasks at once, in bytes; more are joined.
SENT = 16 << 20
#: Sets of at most so many shingles go along where crowds are compared, so that their pairs are tested at once.
CARRIED = 4096
#: The bits of a narrow node that name its tree.
TREES = 1023


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys of each row, sorted, and the n + 1 offsets of the rows in them."""
    n = len(offsets) - 1
    low = TO_LOWER[data]
    starts, ends, row = word_spans(low, offsets)
    words = span_hashes(low, starts, ends)
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    keys, owner = [], []
    if len(words) >= k:
        inside = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
        keys.append(window_hashes(words, k)[inside])
        owner.append(row[inside])
    for w in range(1, k):
        short = np.flatnonzero(counts == w)
        if len(short):
            keys.append(window_hashes(words, w)[first[short]] ^ np.uint64(w))
            owner.append(short)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    if k > 1 and len(owner) > 1 and (owner[1:] < owner[:-1]).any():
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    edges = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    for i in np.flatnonzero(np.diff(edges) > 1):
        keys[edges[i] : edges[i + 1]].sort()
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=n))))


def minwise(keys: np.ndarray, edges: np.ndarray, coords: int = COORDS, kind: type = np.int16) -> np.ndarray:
    """The low bits of the least value of each row under the first `coords` permutations."""
    out = np.zeros((len(edges) - 1, coords), kind)
    rows = np.flatnonzero(np.diff(edges))
    if len(rows):
        x = (keys >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for i in range(coords):
                out[rows, i] = np.minimum.reduceat((x ^ _XOR[i]) * _MULT[i], edges[rows]).astype(f"u{out.itemsize}").view(kind)
    return out


def class_keys(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A key of each row's set, whatever the order of its shingles."""
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(keys), dtype=np.uint64)))
        return mix64(total[edges[1:]] - total[edges[:-1]] + np.diff(edges).astype(np.uint64)).view(np.int64)


def lists(values: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def sketcher(k: int):
    def sketch(batches):
        for batch in batches:
            data, offsets = text_arrays(batch.column("text"))
            for lo, hi in pieces(offsets):
                keys, edges = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                rest = [batch.column(c).slice(lo, hi - lo) for c in ("id", "h")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(edges), pa.int64()), pa.array(class_keys(keys, edges)), lists(minwise(keys, edges))], ["id", "h", "n", "k", "sig"])

    return sketch


def set_maker(k: int):
    """The sets of texts that were fetched for the classes k; a text of another class, under the same id, goes."""

    def sets(batches):
        for batch in batches:
            data, offsets = text_arrays(batch.column("text"))
            for lo, hi in pieces(offsets):
                keys, edges = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                values = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys.view(np.int64)))
                own = pa.array(class_keys(keys, edges))
                out = pa.RecordBatch.from_arrays([own, values], ["k", "shingles"])
                yield out.filter(pa.compute.equal(own, batch.column("k").slice(lo, hi - lo)))

    return sets


def widener(batches):
    """WIDE minwise values of sets: those after COORDS are independent of what chose the nodes; and 32 bits of each shingle, for sets of CARRIED at most."""
    for batch in batches:
        column = batch.column("shingles")
        edges = column.offsets.to_numpy().astype(np.int64)
        keys = column.values.to_numpy()[edges[0] : edges[-1]].view(np.uint64)
        edges = edges - edges[0]
        short = [np.unique((keys[i:j] >> np.uint64(16)).astype(np.uint32)).tobytes() if j - i <= CARRIED else None for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("k"), binary_rows(minwise(keys, edges, WIDE, np.int8)), pa.array(short, pa.binary())], ["k", "sig", "s"])


def refuted(n1: np.ndarray, n2: np.ndarray, s1: list, s2: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the 32 bits of their shingles show not to reach the threshold, and those that they show to; a pair of a set that doesn't carry them is neither.

    Where bits of different shingles of a set are equal, as many more may be in common as the set has lost.
    """
    no, yes = np.zeros(len(n1), bool), np.zeros(len(n1), bool)
    sets: dict[bytes, np.ndarray] = {}
    for i, (x, y) in enumerate(zip(s1, s2, strict=True)):
        if x is None or y is None:
            continue
        one, two = (sets.setdefault(v, np.frombuffer(v, np.uint32)) for v in (x, y))
        both = np.concatenate((one, two))
        both.sort()
        common = int((both[1:] == both[:-1]).sum()) + int(n1[i] - len(one)) + int(n2[i] - len(two))
        yes[i] = common * 100 >= percent * (int(n1[i]) + int(n2[i]) - common)
        no[i] = not yes[i]
    return no, yes


def may_link(n1, n2, s1, s2, percent: int):
    """Whether pairs may reach the threshold, and the share of equal values: by their sizes for certain, by their minwise values but for a tail of 4.5 deviations."""
    alike = np.zeros(len(n1), np.float32)
    good = np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent
    at = np.flatnonzero(good)
    if len(at):
        s, coords = percent / 100, s1.shape[1]
        alike[at] = (s1[at] == s2[at]).mean(1)
        good[at] = alike[at] >= s - 4.5 * math.sqrt(s * (1 - s) / coords)
    return good, alike


def values(column) -> np.ndarray:
    """The lists of a column, or its bytes, as a matrix."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


PAIRS = "a bigint, b bigint, la bigint, lb bigint, alike float"


def pairs_of(a, b, la, lb, alike) -> pa.RecordBatch:
    swap = a > b
    cols = (np.where(swap, b, a), np.where(swap, a, b), np.where(swap, lb, la), np.where(swap, la, lb), alike)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "la", "lb", "alike"])


def narrow_paths(length: int, trees: int, seed: int) -> np.ndarray:
    """The values that each narrow tree takes, none of those that chose the nodes before."""
    return np.stack([np.random.default_rng([seed, t]).choice(np.arange(COORDS, WIDE), length, replace=False) for t in range(trees)])


def once(s1: np.ndarray, s2: np.ndarray, node: np.ndarray, paths: np.ndarray | None) -> np.ndarray:
    """Whether this tree, whose number is in the node's last bits, is the first that brings the pairs together: then it names them."""
    if paths is None or not len(s1):
        return np.ones(len(s1), bool)
    same = s1 == s2
    first = np.full(len(s1), len(paths))
    for t in range(len(paths) - 1, -1, -1):
        first[same[:, paths[t]].all(1)] = t
    return first == (node & TREES)


def comparer(percent: int, paths: np.ndarray | None = None):
    """Pairs of different components among rows with the same node, sorted by node."""

    def compare(batches):
        tail = None
        for batch in _with_end(batches):
            if batch is not None:
                own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "k", "label", "n")}
                own["sig"], own["s"] = values(batch.column("sig")), carried(batch.column("s"))
                rows = own if tail is None else {c: np.concatenate([tail[c], own[c]]) for c in own}
                # the last node may go on in the next batch
                last = rows["node"] == rows["node"][-1]
                cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
                rows, tail = {c: v[:cut] for c, v in rows.items()}, {c: v[cut:] for c, v in rows.items()}
            else:
                rows = tail
            if rows is None or not len(rows["node"]):
                continue
            d = 1
            while d < len(rows["node"]):
                same = np.flatnonzero(rows["node"][d:] == rows["node"][:-d])
                if not len(same):
                    break
                a, b = same, same + d
                apart = rows["label"][a] != rows["label"][b]
                a, b = a[apart], b[apart]
                good, alike = may_link(rows["n"][a], rows["n"][b], rows["sig"][a], rows["sig"][b], percent)
                a, b, alike = a[good], b[good], alike[good]
                new = once(rows["sig"][a], rows["sig"][b], rows["node"][a], paths)
                a, b, alike = a[new], b[new], alike[new]
                no, _ = refuted(rows["n"][a], rows["n"][b], rows["s"][a], rows["s"][b], percent)
                a, b, alike = a[~no], b[~no], alike[~no]
                if len(a):
                    yield pairs_of(rows["k"][a], rows["k"][b], rows["label"][a], rows["label"][b], alike)
                d += 1

    return compare


def carried(column) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _with_end(batches):
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def telling(one: np.ndarray, label: np.ndarray, alike: np.ndarray, sure: float) -> np.ndarray:
    """Which pairs to name: where a class is linked with a label for sure, its best pair with that label says all."""
    order = np.lexsort((-alike, label, one))
    first = np.ones(len(order), bool)
    first[1:] = (one[order][1:] != one[order][:-1]) | (label[order][1:] != label[order][:-1])
    settled = alike[order][first] >= sure
    out = np.zeros(len(order), bool)
    out[order] = first | ~settled[np.cumsum(first) - 1]
    return out


def meeter(percent: int, paths: np.ndarray):
    """Pairs of some members of a node and some others that they meet, both of a bounded number."""

    def fields(cell):
        flat = cell.values
        k, label, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        return k, label, n, values(flat.field(3)), carried(flat.field(4))

    def meet(batches):
        for batch in batches:
            for node, members, others in zip(batch.column("node").to_pylist(), batch.column("members"), batch.column("others"), strict=True):
                (k, label, n, sig, held), (ok, olabel, on, osig, oheld) = fields(members), fields(others)
                a, b = np.nonzero(label[:, None] != olabel[None, :])
                good, alike = may_link(n[a], on[b], sig[a], osig[b], percent)
                a, b, alike = a[good], b[good], alike[good]
                new = once(sig[a], osig[b], np.full(len(a), node), paths)
                a, b, alike = a[new], b[new], alike[new]
                no, yes = refuted(n[a], on[b], held[a], oheld[b], percent)
                alike[yes] = 2.0  # sure
                a, b, alike = a[~no], b[~no], alike[~no]
                s = percent / 100  # above the threshold by as many deviations as the filter leaves below it
                if len(a):  # members of one label say the same of it
                    good = telling(b, label[a], alike, s + 4.5 * math.sqrt(s * (1 - s) / WIDE))
                    a, b, alike = a[good], b[good], alike[good]
                    yield pairs_of(k[a], ok[b], label[a], olabel[b], np.minimum(alike, 1))

    return meet


def leader_filter(percent: int):
    """Pairs of a node's members with its leader."""

    def filtered(batches):
        for b in batches:
            if not b.num_rows:
                continue
            k, n, label, lead, lead_n, lead_label = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "n", "label", "lead", "lead_n", "lead_label"))
            good, alike = may_link(n, lead_n, values(b.column("sig")), values(b.column("lead_sig")), percent)
            yield pairs_of(k[good], lead[good], label[good], lead_label[good], alike[good])

    return filtered


def fetched(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """k and the set of each wanted class (k, rep, h), made anew from a text of it."""
    same = docs["id"].eqNullSafe(wanted["rep"]) & (docs["h"] == wanted["h"])
    made = docs.join(wanted, same).select("k", "text").mapInArrow(set_maker(words), "k bigint, shingles array<bigint>")
    return made.dropDuplicates(["k"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that reach the threshold on full sets."""
    left, right = sets.select(F.col("k").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("k").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    return both.where(F.col("i") * 100 >= percent * (F.col("t") - F.col("i"))).select("a", "b", "la", "lb")


def learnt(pairs: DataFrame, sets: DataFrame, tables: Tables, percent: int) -> tuple[DataFrame, DataFrame]:
    """The most alike pair of any two labels, where it is a link; and labels joined by these."""
    best = pairs.groupBy(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).agg(F.max_by(F.struct("a", "b", "la", "lb"), F.struct("alike", "a", "b")).alias("p")).select("p.*")
    links = tables.put(confirmed(best, sets, percent))
    return links, components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")), tables, 2)


def components(edges: DataFrame, tables: Tables, rounds: int | None = None) -> DataFrame:
    """k and the smallest key of its component, for each k that has an edge.

    rounds: stop after so many, with labels that may still differ within a component, where that only saves work.
    The tables of links are small beside the documents, so fewer tasks write them.
    """
    both = tables.put(edges.union(edges.select("b", "a")).where("a <> b").distinct().toDF("k", "v"), True)
    labels = tables.put(both.groupBy("k").agg(F.least(F.min("v"), F.col("k")).alias("c")), True)
    turn = 0
    while labels.limit(1).count():
        near = both.join(labels.select(F.col("k").alias("v"), F.col("c").alias("vc")), "v").groupBy("k").agg(F.min("vc").alias("vc"))
        step = tables.put(labels.join(near, "k").select("k", F.least("c", "vc").alias("c"), F.col("c").alias("old")), True)
        jump = step.select(F.col("k").alias("c"), F.col("c").alias("cc"))
        new = tables.put(step.join(jump, "c", "left").select("k", F.coalesce("cc", "c").alias("c"), "old"), True)
        tables.drop(labels)
        tables.drop(step)
        labels = new.select("k", "c")
        labels._civicspark_path = new._civicspark_path
        turn += 1
        if turn == rounds or not new.where("c <> old").limit(1).count():
            break
    tables.drop(both)
    return labels


def relabel(rows: DataFrame, comps: DataFrame, label: str = "label") -> DataFrame:
    """rows with a label; labels become their components'."""
    return rows.join(comps.select(F.col("k").alias(label), "c"), label, "left").withColumn(label, F.coalesce("c", label)).drop("c")


def missed(percent: int, depth: int, trees: int) -> float:
    """The chance that two sets at the threshold share no node of `depth` levels in any of the trees, which choose from the same COORDS values."""
    s, total = percent / 100, 0.0
    for m in range(COORDS + 1):
        lost, q = 0.0, m / COORDS
        for _ in range(depth):
            lost = (1 - q + q * lost) ** 2
        total += math.comb(COORDS, m) * s**m * (1 - s) ** (COORDS - m) * lost**trees
    return total


def several(level: DataFrame) -> DataFrame:
    """Nodes with two labels or more: size, the most frequent label, and how many classes have another."""
    held = level.groupBy("node", "label").agg(F.count("*").alias("c")).groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("top"))
    return held.where(F.col("size") > F.col("top.c")).select("node", "size", F.col("top.label").alias("major"), (F.col("size") - F.col("top.c")).alias("rest"))


def led(level: DataFrame, classes: DataFrame, percent: int, tables: Tables | None = None) -> DataFrame:
    """Pairs of classes with the leader of their node. level: node, k, label, weight; classes: k, n, sig. tables: where the leaders are few."""
    leads = level.groupBy("node").agg(F.max_by(F.struct("k", "label"), F.struct("weight", "k")).alias("l")).select("node", F.col("l.k").alias("lead"), F.col("l.label").alias("lead_label"))
    pairs = level.select("node", "k", "label").join(leads, "node").where((F.col("k") != F.col("lead")) & (F.col("label") != F.col("lead_label"))).select("k", "label", "lead", "lead_label").distinct()
    own = classes.select(F.col("k").alias("lead"), F.col("n").alias("lead_n"), F.col("sig").alias("lead_sig"))
    if tables is not None:  # a crowd's leaders are few, and each has many classes
        own = tables.put(own.join(leads.select("lead").distinct(), "lead", "left_semi"))
        own = F.broadcast(own) if own.count() * WIDE <= SENT else own
    pairs = pairs.join(classes.select("k", "n", "sig"), "k").join(own, "lead")
    return pairs.mapInArrow(leader_filter(percent), PAIRS)


def compared(level: DataFrame, classes: DataFrame, percent: int, paths: np.ndarray | None = None) -> DataFrame:
    """Pairs within nodes, exhaustively; nodes are small. level: node, k, label; classes: k, n, sig."""
    s = F.col("s") if "s" in classes.columns else F.lit(None).cast("binary").alias("s")
    rows = level.select("node", "k", "label").join(classes.select("k", "n", "sig", s), "k").select("node", "k", "label", "n", "sig", "s")
    return rows.repartition(scan_tasks(level.sparkSession), "node").sortWithinPartitions("node").mapInArrow(comparer(percent, paths), PAIRS)


def met(level: DataFrame, classes: DataFrame, percent: int, small: int, seed: int, paths: np.ndarray) -> DataFrame:
    """Pairs of the classes outside a node's main label with all others of the node, in chunks. level: node, k, label, size, major, rest."""
    chunk = lambda count, most: F.pmod(F.xxhash64("k", F.lit(seed)), F.ceil(F.col(count) / most))
    rows = level.join(classes.select("k", "n", "sig", "s"), "k")
    row = F.struct("k", "label", "n", "sig", "s")
    others = rows.where("label <> major").groupBy("node", chunk("rest", small).alias("chunk")).agg(F.collect_list(row).alias("others")).select("node", "others")
    members = rows.groupBy("node", chunk("size", CHUNK).alias("chunk")).agg(F.collect_list(row).alias("members")).select("node", "members")
    return members.join(others, "node").select("node", "members", "others").mapInArrow(meeter(percent, paths), PAIRS)


def crowd_pairs(level: DataFrame, docs: DataFrame, classes: DataFrame, tables: Tables, words: int, percent: int, recall: float, small: int, seed: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """For the classes of large nodes (node, k, label): some links, further pairs to confirm, and the labels after those links (k, label)."""
    s = percent / 100
    wanted = classes.join(level.select("k").distinct(), "k", "left_semi").select("k", "rep", "h")
    sets = tables.put(fetched(wanted, docs, words))
    crowd = tables.put(sets.mapInArrow(widener, "k bigint, sig binary, s binary").join(classes.select("k", "n"), "k").select("k", "n", "sig", "s"))
    near = tables.put(led(level.select("node", "k", "label").withColumn("weight", F.xxhash64("k", F.lit(seed))), crowd, percent, tables))
    links, comps = learnt(near, sets, tables, percent)
    labels = tables.put(relabel(level.select("k", "label").distinct(), comps))
    nodes = tables.put(level.select("node", "k").join(labels, "k"))
    level = tables.put(nodes.join(several(nodes).where(F.col("size") > small).select("node", "size"), "node"))
    largest = level.agg(F.max("size")).first()[0]
    if not largest:
        return links, [near], labels
    # the longest paths for which there are trees enough; shorter ones leave larger nodes, which are compared in chunks
    needed = lambda x: math.ceil(math.log(1 - recall) / math.log(1 - s**x))
    length = next(x for x in range(min(20, max(4, math.ceil(math.log(largest / small, 2)))), 0, -1) if x == 1 or needed(x) <= TREES + 1)
    if needed(length) > TREES + 1:
        raise ValueError(f"recall {recall} at {percent} % needs more than {TREES + 1} trees")
    paths = narrow_paths(length, needed(length), seed)
    grown = level.select("k").distinct().join(crowd.select("k", "sig"), "k").join(labels, "k").select("k", "label", "sig")
    grown = tables.put(grown.mapInArrow(brancher(paths), "node bigint, k bigint, label bigint"))
    level = tables.put(grown.join(several(grown), "node"))
    tables.drop(grown)
    few = F.col("size") <= CHUNK
    pairs = compared(level.where(few), crowd, percent, paths).union(met(level.where(~few), crowd, percent, small, seed, paths))
    return links, [near, tables.put(pairs)], labels


def brancher(paths: np.ndarray):
    """The nodes of classes in the narrow trees: a hash of the values that a tree takes, with the tree's number."""

    def branch(batches):
        for batch in batches:
            sig = values(batch.column("sig")).view(np.uint8)
            with np.errstate(over="ignore"):
                for t, path in enumerate(paths):
                    out = np.full(len(sig), t + 1, np.uint64)
                    for c in path:
                        out = mix64(out + sig[:, c].astype(np.uint64))
                    node = (out.view(np.int64) & ~np.int64(TREES)) | np.int64(t)
                    yield pa.RecordBatch.from_arrays([pa.array(node), batch.column("k"), batch.column("label")], ["node", "k", "label"])

    return branch


def judged(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, recall: float, small: int, depth: int, leader_bands: int, seed: int) -> DataFrame:
    """Per row: id, h (hash of the text), n (size of its set), k (its class, null without words), component and kept."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "near-dup")
    trees = next((t for t in range(1, 64) if missed(percent, depth, t) <= 1 - recall), None)
    if trees is None:
        raise ValueError(f"recall {recall} at {percent} % is out of reach of 63 trees of depth {depth}")
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    sketch = tables.put(slim.mapInArrow(sketcher(words), f"id {kind}, h bigint, n bigint, k bigint, sig array<smallint>"))
    # One row for each set; the values are the same for all its copies.
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "h")).alias("f")
    classes = tables.put(sketch.where("n > 0").groupBy("k").agg(first, F.min("n").alias("n"), F.first("sig").alias("sig")).select("k", F.col("f.id").alias("rep"), F.col("f.h").alias("h"), "n", "sig"))
    own = classes.select("k", F.col("k").alias("label"), "sig")

    # Leaders: short paths; each class against the one with the most company in all its nodes, the middle of a group of near copies.
    def band(b):
        at = [int(x) for x in np.random.default_rng(seed * 1000 + b).choice(COORDS, 3, replace=False)]
        return F.xxhash64(F.lit(b), *(F.col("sig")[i] for i in at))

    banded = own.select("k", "label", F.explode(F.array(*(band(b) for b in range(leader_bands)))).alias("node"))
    company = banded.join(banded.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "node")
    company = tables.put(company.groupBy("k").agg(F.sum("size").alias("weight")))
    pairs = tables.put(led(banded.join(company, "k"), classes, percent))
    sets = tables.put(fetched(_named(pairs, classes), slim, words))
    links = [tables.put(confirmed(pairs, sets, percent))]
    tables.drop(sets)
    comps = components(links[0].select("a", "b"), tables, 3)

    # Trees: two levels at once, then on while nodes are large and hold more than one component.
    rows = tables.put(relabel(own, comps))
    pairs, level = [], rows
    for d in range(2, depth + 1):
        if d == 2:
            node = [_child(_child(F.xxhash64(F.lit(seed), F.lit(t)), i, seed), j, seed) for t in range(trees) for i in range(2) for j in range(2)]
            grown = level.select("k", "label", F.explode(F.array(*node)).alias("node"))
        else:
            grown = level.join(classes.select("k", "sig"), "k").select("k", "label", F.explode(F.array(*(_child(F.col("node"), j, seed) for j in range(2)))).alias("node"))
        level = tables.put(grown.join(several(grown).select("node", "size"), "node"))
        pairs.append(tables.put(compared(level.where(F.col("size") <= small), classes, percent)))
        level = level.where(F.col("size") > small)
    labels = rows.select("k", "label")
    if level.limit(1).count():
        more, others, crowd = crowd_pairs(level, slim, classes, tables, words, percent, recall, small, seed)
        links.append(more)
        pairs += others
        labels = labels.join(crowd.select("k", F.col("label").alias("later")), "k", "left").select("k", F.coalesce("later", "label").alias("label"))
    found = pairs[0].select("a", "b", "alike")
    for p in pairs[1:]:
        found = found.union(p.select("a", "b", "alike"))
    found = found.groupBy("a", "b").agg(F.max("alike").alias("alike"))
    now = labels.select(F.col("k").alias("a"), F.col("label").alias("la")), labels.select(F.col("k").alias("b"), F.col("label").alias("lb"))
    found = tables.put(found.join(now[0], "a").join(now[1], "b").where("la <> lb").select("a", "b", "la", "lb", "alike"))
    links.append(tables.put(confirmed(found, tables.put(fetched(_named(found, classes), slim, words)), percent)))

    edges = links[0].select("a", "b")
    for link in links[1:]:
        edges = edges.union(link.select("a", "b"))
    member = relabel(classes.select("k", "rep", F.col("k").alias("label")), components(edges, tables))
    smallest = member.groupBy("label").agg(F.min("rep").alias("component"))
    member = tables.put(member.join(smallest, "label").select("k", "component", F.col("label").alias("group")))
    out = sketch.select("id", "h", "n", F.when(F.col("n") > 0, F.col("k")).alias("k")).join(member, "k", "left")
    out = out.withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()))


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    return classes.join(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct(), "k", "left_semi").select("k", "rep", "h")


def _child(node, j: int, seed: int):
    at = F.pmod(F.xxhash64(node, F.lit(j), F.lit(seed)), F.lit(COORDS)).cast("int") + 1
    return F.xxhash64(node, at, F.element_at(F.col("sig"), at))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, recall: float = 0.9995, small: int = 24, depth: int = 3, leader_bands: int = 8, seed: int = 5) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links) and kept (id = component_id).

    words: words in a shingle; percent: shared shingles of the pair's union, in hundredths, for a link.
    recall: the chance that a pair at the threshold is compared. small, depth: see above. leader_bands: short paths of
    three coordinates that leaders are taken from.
    """
    out = judged(docs, id_col, text_col, words, percent, recall, small, depth, leader_bands, seed)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, recall: float = 0.9995, small: int = 24, depth: int = 3, leader_bands: int = 8, seed: int = 5) -> DataFrame:
    """One row of each component, with the columns it came with; rows without words all stay.

    Where the representative's id occurs more than once, the text of the least hash stays, once.
    """
    tables = Tables(docs.sparkSession, "kept")
    rows = judged(docs, id_col, text_col, words, percent, recall, small, depth, leader_bands, seed).where("kept AND n > 0")
    one = rows.groupBy("group", "id", "h").agg(F.count("*").alias("times")).groupBy("group").agg(F.min(F.struct("h", "id", "times")).alias("o"))
    one = tables.put(one.select(F.col("o.id").alias("_id"), F.col("o.h").alias("_h"), F.col("o.times").alias("_times")))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn("_text_hash", F.xxhash64(text))
    wordless = F.coalesce(~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    same = lambda few: F.col(id_col).eqNullSafe(few["_id"]) & (F.col("_text_hash") == few["_h"])
    single, repeated = one.where("_times = 1"), one.where("_times > 1")
    stay = keyed.join(single, same(single), "left_semi").where(~wordless)
    # copies of one row: any of them, chosen with a partial aggregation before the shuffle
    stay = stay.union(keyed.join(repeated, same(repeated), "left_semi").where(~wordless).dropDuplicates([id_col, "_text_hash"]))
    return stay.union(keyed.where(wordless)).drop("_text_hash")


def op1_near_dup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
