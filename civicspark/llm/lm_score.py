"""Language-model scores by a weighted backoff automaton; of order 3 unless `mu` says more.

Tokens are the words (A-Z lower-cased) and an end per text. A state is the context of a token: the two (three, ...) tokens
before it, or all there are from the start of the text on. From a state h an arc for each token w seen after h in
training goes on; whatever else comes takes the failure arc to the state of the context without its first token, in
the end to the root, where each token has an arc (unseen ones share one). Weights are smoothed with a Dirichlet
prior for each order, of strength `mu`: root arcs p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), arcs of h
(c(hw) + mu p(w after h')) / (c(h) + mu) with h' the shorter context, failure arcs mu / (c(h) + mu); what leaves a
state sums to one. A context never seen has its failure arc alone, with weight one. A traversal goes left to right,
carries the state and adds up log10 weights. The contexts of a place are the tokens before it, so numpy takes the arcs of a
block of texts at once, order by order.

The counts grow with the corpus and are never gathered in one place. Texts are dealt by hash to blocks of about
`block_bytes`. A block sends its distinct tokens and pairs (64-bit keys, sorted, with its own training counts) to the parts of
the key space; a part adds up the counts of all blocks and answers each block in the order of its question. In further rounds the block
asks for its runs of three tokens, then of four, in the same way, but only for those that may occur in other
blocks: where a shorter run within a run has all its occurrences in this block, so has the run, and the block's own count is
the whole one. The block then holds just the arcs that it needs, and traverses. Keys, blocks and parts have sizes that
don't depend on the corpus; only their numbers do. The texts are shuffled once and that shuffle is used in all rounds.

Defined results: a null or empty text is the end alone. Repeated rows get a row each and count each. Without
training rows every count is 0: base and model give each token the unseen weight. No rows give no rows. Only the
id and text columns are read; a null id counts as training.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pieces, span_hashes, table, text_arrays, word_spans
from .common import TO_LOWER

END, START = np.uint64(0xE5D1F3A7C2B49681), np.uint64(0x5A17B0C4D93E6F27)
ADD = 0.1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of text: token keys, keys of the arcs that they take from the state before, and the rows of both."""
    n = len(offsets) - 1
    parts = []
    for lo, hi in pieces(offsets):
        own, rel = TO_LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, row = word_spans(own, rel)
        counts = np.bincount(row, minlength=hi - lo)
        keys = np.full(len(starts) + hi - lo, END, np.uint64)
        keys[np.arange(len(starts)) + row] = span_hashes(own, starts, ends)
        parts.append((keys, np.repeat(np.arange(lo, hi), counts + 1)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
    before = before_keys(keys, rows)
    with np.errstate(over="ignore"):
        arcs = mix64(before * np.uint64(0x9E3779B97F4A7C15) + (keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93))
    return keys, arcs, rows


def before_keys(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys), np.uint64)
    out[0] = START
    out[1:] = np.where(rows[1:] == rows[:-1], keys[:-1], START)
    return out


def longer(chain: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys of runs that are one token longer: the run up to the token before, and the token."""
    out = np.zeros(len(keys), np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = mix64(chain[:-1] * np.uint64(0x9E3779B97F4A7C15) + keys[1:])
    return out


def depth(rows: np.ndarray) -> np.ndarray:
    """How many tokens of its text come before each."""
    at = np.arange(len(rows))
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    return at - np.maximum.accumulate(np.where(first, at, 0))


def before(x: np.ndarray, n: int = 1):
    """The values n places before; false or 0 at the start."""
    out = np.zeros_like(x)
    out[n:] = x[:-n]
    return out


def pack(x: np.ndarray) -> bytes:
    """Bytes by place value: the high ones of sorted keys and of counts are alike, and shuffles compress them."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unpack(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeeze(x: np.ndarray) -> bytes:
    """Packed and compressed further than a shuffle does, with the length before it."""
    planes = pack(x)
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(blob: pa.Buffer, kind) -> np.ndarray:
    size = int.from_bytes(blob[:8].to_pybytes(), "little")
    return unpack(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), kind)


def squeeze_keys(x: np.ndarray) -> bytes:
    """Of sorted keys: the first and the differences."""
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def unsqueeze_keys(blob: pa.Buffer) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, np.uint64), dtype=np.uint64)


def question(block: pa.Table, parts: int, keys: list[tuple[np.ndarray, np.ndarray]], texts: int) -> pa.Table:
    """Distinct keys and their training counts in this block, by part of the key space. keys: two arrays, each with what of it is learnt."""
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    cols = []
    for x, learnt in keys:
        distinct, at = np.unique(x, return_inverse=True)
        count = np.bincount(at[learnt], minlength=len(distinct)).astype(np.uint32)
        bounds = np.concatenate(([0], np.searchsorted(distinct, cuts), [len(distinct)]))
        cols.append([(squeeze_keys(distinct[a:b]), squeeze(count[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    b = block.column("block")[0].as_py()
    return pa.table(
        [pa.array(np.arange(parts), pa.int32()), pa.array([b] * parts, pa.int32()), pa.array([texts] * parts, pa.int64()), *(pa.array([c[i] for c in col], pa.binary()) for col in cols for i in (0, 1))],
        names=["part", "block", "texts", "k1", "c1", "k2", "c2"],
    )


def questioner(parts: int):
    """A block's distinct tokens and pairs."""

    def ask(block: pa.Table) -> pa.Table:
        data, offsets = text_arrays(block.column("text"))
        training = block.column("training").to_numpy()
        keys, arcs, rows = tokens(data, offsets)
        return question(block, parts, [(keys, training[rows]), (arcs, training[rows])], int(training.sum()))

    return ask


def answer(kind: int):
    def counts(part: pa.Table) -> pa.Table:
        """Counts over all blocks for each block's keys, in its order; with the part's numbers of types and tokens."""
        out = {}
        types = total = 0
        for k, c in (("k1", "c1"), ("k2", "c2")):
            asked = [unsqueeze_keys(x.as_buffer()) for x in part.column(k)]
            own = [unsqueeze(x.as_buffer(), np.uint32) for x in part.column(c)]
            every = np.concatenate(asked)
            order = np.argsort(every, kind="stable")
            s = every[order]
            first = np.ones(len(s), bool)
            first[1:] = s[1:] != s[:-1]
            group = np.cumsum(first) - 1
            sums = np.bincount(group, weights=np.concatenate(own)[order]).astype(np.uint64) if len(s) else np.zeros(0, np.uint64)
            counts = np.empty(len(s), np.uint64)
            counts[order] = sums[group]
            edges = np.cumsum([0, *map(len, asked)])
            out[c] = [squeeze(counts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if k == "k1":
                types, total = int((sums > 0).sum()), int(sums.sum())
        n = len(part)
        texts = sum(part.column("texts").to_pylist())
        return pa.table(
            [part.column("block"), part.column("part"), pa.array([kind] * n, pa.int32()), pa.array([types] * n, pa.int64()), pa.array([total] * n, pa.int64()), pa.array([texts] * n, pa.int64()), pa.array(out["c1"], pa.binary()), pa.array(out["c2"], pa.binary())],
            names=["block", "part", "kind", "types", "total", "texts", "c1", "c2"],
        )

    return counts


def answered(answers: pa.Table, kind: int, column: str) -> np.ndarray:
    own = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("part")
    return np.concatenate([unsqueeze(x.as_buffer(), np.uint64) for x in own.column(column)])


def asked_runs(apart: np.ndarray, deep: np.ndarray, order: int) -> np.ndarray:
    """Places whose run of `order` tokens must be asked for: both runs in it that are one shorter occur elsewhere."""
    return apart & before(apart) & (deep >= order - 2)


def counted(keys: np.ndarray, arcs: np.ndarray, learnt: np.ndarray, deep: np.ndarray, answers: pa.Table, upto: int):
    """For each order from 2 on: keys of the runs that end at each place, their counts, and whether they occur in other blocks' training texts."""
    chain, asked, out = arcs, np.ones(len(keys), bool), []
    for order in range(2, upto + 1):
        if order > 2:
            chain, asked = longer(chain, keys), asked_runs(out[-1][2], deep, order)
        here = np.flatnonzero(deep >= order - 2)
        distinct, at = np.unique(chain[here], return_inverse=True)
        own = np.bincount(at[learnt[here]], minlength=len(distinct))
        total, open_ = own.astype(np.uint64), np.zeros(len(distinct), bool)
        open_[at[asked[here]]] = True
        if open_.any():
            total[open_] = answered(answers, order - 1, "c2" if order == 2 else "c1")
        count, apart = np.zeros(len(keys)), np.zeros(len(keys), bool)
        count[here], apart[here] = total[at], (own < total)[at]
        out.append((chain, count, apart))
    return out


def asker(parts: int, order: int):
    """A block's distinct runs of `order` tokens that may occur in other blocks."""

    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets = text_arrays(block.column("text"))
        keys, arcs, rows = tokens(data, offsets)
        learnt, deep = block.column("training").to_numpy()[rows], depth(rows)
        chain, _, apart = counted(keys, arcs, learnt, deep, answers, order - 1)[-1]
        asked = asked_runs(apart, deep, order)
        return question(block, parts, [(longer(chain, keys)[asked], learnt[asked]), (np.zeros(0, np.uint64), np.zeros(0, bool))], 0)

    return ask


def traverser(mu: tuple[float, ...], schema: pa.Schema):
    def traverse(block: pa.Table, answers: pa.Table) -> pa.Table:
        one = answers.filter(pc.equal(answers.column("kind"), 1))
        total, types = (sum(one.column(c).to_pylist()) for c in ("total", "types"))
        texts = one.column("texts")[0].as_py()
        data, offsets = text_arrays(block.column("text"))
        keys, arcs, rows = tokens(data, offsets)
        learnt, deep = block.column("training").to_numpy()[rows], depth(rows)
        seen = answered(answers, 1, "c1").astype(np.float64)[np.unique(keys, return_inverse=True)[1]]
        root = (seen + ADD) / (total + ADD * (types + 1))
        # the state before a token: its count is that of the run that it is; the start was left once in each text
        weight, state = root, np.where(deep > 0, before(seen), texts)
        for order, (_, count, _) in enumerate(counted(keys, arcs, learnt, deep, answers, len(mu) + 1), 2):
            weight = np.where(deep >= order - 2, (count + mu[order - 2] * weight) / (state + mu[order - 2]), weight)
            state = before(count)
        n = len(block)
        add = lambda x: np.bincount(rows, weights=x, minlength=n)
        cols = [block.column("id"), pa.array(~block.column("training").to_numpy()), np.bincount(rows, minlength=n), add(seen > 0).astype(np.int64), np.full(n, total), add(np.log10(root)), add(np.log10(weight))]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c).cast(schema.field(i).type) for i, c in enumerate(cols)], schema=schema)

    return traverse


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training=None, mu: tuple[float, ...] = (200.0, 50.0), block_bytes: int = 12 << 20, part_bytes: int = 24 << 20) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score (root arcs alone) and score (the automaton).

    training: a boolean column of the rows to learn from; by default those whose crc32(id as text) mod 10 is not 0.
    mu: strengths of the priors of the orders 2, 3 (and so on), in tokens; as many as there are orders above 1.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if training is None:
        training = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) != 0, F.lit(True))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")) + 8)).first()[0] or 0
    blocks, parts = max(1, math.ceil(total / block_bytes)), max(1, math.ceil(total / part_bytes))
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), training.alias("training"))
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(2 * blocks, "block")
    posed = "part int, block int, texts bigint, k1 binary, c1 binary, k2 binary, c2 binary"
    reply = "block int, part int, kind int, types bigint, total bigint, texts bigint, c1 binary, c2 binary"
    ask = dealt.groupBy("block").applyInArrow(questioner(parts), posed)
    known = ask.repartition(2 * parts, "part").groupBy("part").applyInArrow(answer(1), reply)
    for order in range(3, len(mu) + 2):
        more = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(asker(parts, order), posed)
        known = known.unionByName(more.repartition(2 * parts, "part").groupBy("part").applyInArrow(answer(order - 1), reply))
    schema = pa.schema([("id", to_arrow_type(slim.schema["id"].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    out = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(traverser(mu, schema), f"id {dict(docs.dtypes)[id_col]}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op4_lm_score(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
