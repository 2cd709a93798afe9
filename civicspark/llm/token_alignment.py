"""Alignment of the tokens of two tokenizers over the same texts.

Token lengths in bytes, summed up, are token ends; ends that both tokenizers have are cuts. A cut's number is the group of the
tokens that end at it or before it, back to the cut before. A link is a pair of token occurrences, one of each tokenizer,
whose byte ranges end together; where several tokens end at one place (tokens of no bytes do), all pairs there are links.
Many texts are aligned at once: each has a range of byte places of its own.

Counts over the corpus: a task packs its texts into blocks of about `block_bytes`. A block has a list of its distinct id pairs
with their counts, and its links as places in that list, so a pair is sent once a block, however often it occurs. Pairs are
summed by pair and salt, then by pair; the highest count of each id of the second tokenizer is a table no longer than its
vocabulary. Each block gets the counts of its own pairs back and sums them up by document.

The tokenizers' files are read by the driver and sent to the tasks: a few MB, whatever the corpus.

Defined results: a text that is null or empty, or whose tokens' bytes aren't a space and the text (a tokenizer that changes
white space or letters), has no tokens: zeros and an empty digest. Names of special tokens in a text are plain text. Null ids
and repeated rows are rows like any other, and each counts. No rows give no rows. Only the id and the text are read. A text of
any length is aligned as a whole, in a block of its own if need be.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, pieces, table, text_arrays

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Text that goes to the tokenizers at once.
PIECE = 1 << 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it shows, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_level(file: bytes):
    """An encoder of texts to lists of ids, the bytes of each id, and whether these always are the text's, for a byte-level vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks take the cores
    from tokenizers import Tokenizer

    own = Tokenizer.from_buffer(file)
    own.encode_special_tokens = True
    letters = byte_letters()
    names = own.get_vocab(with_added_tokens=True)
    table = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        table[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
    return lambda texts: [e.ids for e in own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], tuple(table), own.normalizer is None and all(c in names for c in letters)


@lru_cache(maxsize=4)
def pieced(file: bytes):
    """As byte_level, for a vocabulary of pieces; this tokenizer adds the space itself."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_proto=file)
    table = tuple(bytes([int(own.id_to_piece(i)[1:-1], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size()))
    return lambda texts: own.encode(texts, num_threads=1), table, False


def once(ascending: np.ndarray) -> np.ndarray:
    return ascending[np.concatenate(([True], ascending[1:] != ascending[:-1]))[: len(ascending)]]


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the ascending ends of two rows of tokens: the cuts, each token's group, and the links as places in the rows."""
    cuts = np.intersect1d(once(ends_a), once(ends_b), assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    if (ends_a[1:] > ends_a[:-1]).all() and (ends_b[1:] > ends_b[:-1]).all():  # one of each at a cut: the last of its group
        return cuts, group_a, group_b, *(np.flatnonzero(np.diff(g, append=len(cuts))) for g in (group_a, group_b))
    first_a, first_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    at_a, at_b = np.searchsorted(ends_a, cuts, "right") - first_a, np.searchsorted(ends_b, cuts, "right") - first_b
    each = at_a * at_b
    turn = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    wide = np.repeat(at_b, each)
    return cuts, group_a, group_b, np.repeat(first_a, each) + turn // wide, np.repeat(first_b, each) + turn % wide


class Aligned:
    """Some texts with their tokens: flat ids of both tokenizers, groups and links. bounds_*: tokens before each text, and all."""

    def __init__(self, texts: list[str], a, b) -> None:
        (encode_a, bytes_a, whole_a), (encode_b, bytes_b, whole_b) = a, b
        ids_a, ids_b = encode_a(texts), encode_b(texts)
        raw = [b" " + t.encode() for t in texts]
        for i, (text, whole) in enumerate(zip(texts, raw, strict=True)):
            if not text or not (whole_a or b"".join(map(bytes_a.__getitem__, ids_a[i])) == whole) or not (whole_b or b"".join(map(bytes_b.__getitem__, ids_b[i])) == whole):
                ids_a[i] = ids_b[i] = []
        lengths = np.fromiter((len(t) + 1 for t in raw), np.int64, len(texts))  # one place more than bytes: ranges don't touch
        base = np.cumsum(lengths) - lengths
        self.a, self.bounds_a, ends_a = self._flat(ids_a, bytes_a, base)
        self.b, self.bounds_b, ends_b = self._flat(ids_b, bytes_b, base)
        self.cuts, self.group_a, self.group_b, self.link_a, self.link_b = common_cuts(ends_a, ends_b)
        text_of = np.repeat(np.arange(len(texts)), np.diff(self.bounds_a))
        self.link_text = text_of[self.link_a]
        self.n_links = np.bincount(self.link_text, minlength=len(texts))
        self.n_groups = self.n_links if len(self.cuts) == len(self.link_a) else np.bincount(np.searchsorted(base, self.cuts, "right") - 1, minlength=len(texts))
        self.pairs = (self.a[self.link_a] << 32) | self.b[self.link_b]

    @staticmethod
    def _flat(ids: list[list[int]], names: tuple[bytes, ...], base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([np.array(i, np.int64) for i in ids]) if len(ids) else np.zeros(0, np.int64)
        long = np.cumsum(_lengths(names)[flat]) if len(flat) else np.zeros(0, np.int64)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        before = np.concatenate(([0], long))[bounds[:-1]]
        return flat, bounds, long + np.repeat(base - before, counts)

    def digests(self) -> list[str]:
        """Of each text: the SHA-256 of its groups, ids with commas, `|` between the tokenizers, `;` between groups."""
        # a group's tokens: those of the first tokenizer come after all earlier groups of both, those of the second after them
        n_a, n_b = np.bincount(self.group_a, minlength=len(self.cuts)), np.bincount(self.group_b, minlength=len(self.cuts))
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        at_a, at_b = np.arange(len(self.a)) + (end_b - n_b)[self.group_a], np.arange(len(self.b)) + end_a[self.group_b]
        ids, sign = np.empty(len(self.a) + len(self.b), np.int64), np.zeros(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        sign[end_a + end_b - n_b - 1] = 1
        sign[end_a + end_b - 1] = 2
        words = _numbers(max(int(ids.max()) + 1, 1 << 16) if len(ids) else 1)
        said = list(map(words.__getitem__, (ids * 3 + sign).tolist()))
        bounds = (self.bounds_a + self.bounds_b).tolist()
        return [hashlib.sha256(b"".join(said[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


_LENGTHS: dict[int, tuple[tuple[bytes, ...], np.ndarray]] = {}


def _lengths(names: tuple[bytes, ...]) -> np.ndarray:
    """Bytes of each id; kept by the table itself, whose hash would take as long."""
    if id(names) not in _LENGTHS:
        _LENGTHS[id(names)] = names, np.fromiter(map(len, names), np.int64, len(names))
    return _LENGTHS[id(names)][1]


@lru_cache(maxsize=4)
def _numbers(n: int) -> list[bytes]:
    """Decimals of ids with the sign that follows: comma, bar, semicolon."""
    return [b"%d%s" % (i, s) for i in range(n) for s in (b",", b"|", b";")]


def slim_bytes(numbers: np.ndarray) -> bytes:
    """Small whole numbers, the four bytes of each apart, deflated."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def from_slim(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


#: A block's rows: one a text, and one with its distinct pairs, their counts and its links in order, as places in the list of pairs.
BLOCKS = "block bigint, no int, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, counts binary, places binary"


def blocker(files: tuple, schema: pa.Schema, block_bytes: int):
    """The rows of the blocks. A block is named by its task and its turn there: the table is written once, by one job."""

    def block(batches):
        a, b = byte_level(files[0].value), pieced(files[1].value)
        part, turn, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def closed():
            coded = pa.array(np.concatenate(held)).dictionary_encode()
            places, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            own = {"block": [(part << 32) | turn], "no": [-1], "pairs": [zlib.compress(pairs.astype("<i8").tobytes(), 1)], "counts": [slim_bytes(np.bincount(places, minlength=len(pairs)))], "places": [slim_bytes(places)]}
            return pa.RecordBatch.from_arrays([pa.array(own.get(f.name, [None]), f.type) for f in schema], schema=schema)

        for batch in batches:
            _, offsets = text_arrays(batch.column("text"))
            for lo, hi in pieces(offsets, PIECE):
                texts = pc.fill_null(batch.column("text").slice(lo, hi - lo), "")
                coded = texts.dictionary_encode()  # copies are aligned once
                which, own = coded.indices.to_numpy(), Aligned(coded.dictionary.to_pylist(), a, b)
                said = np.array(own.digests(), object)[which]
                counted = (np.diff(own.bounds_a), np.diff(own.bounds_b), own.n_groups, own.n_links)
                no = np.arange(n, n + hi - lo)
                rows = {"block": np.full(hi - lo, (part << 32) | turn), "no": no, "id": batch.column("id").slice(lo, hi - lo), **{c: v[which] for c, v in zip(COUNTS, counted, strict=True)}, "groups_sha256": said}
                yield pa.RecordBatch.from_arrays([r if isinstance(r := rows[f.name], pa.Array) else pa.array(r, f.type) if f.name in rows else None for f in schema if f.name in rows] + [pa.nulls(hi - lo, f.type) for f in schema if f.name not in rows], schema=schema)
                edges = np.concatenate(([0], np.cumsum(own.n_links)))
                lengths = own.n_links[which]
                at = np.repeat(edges[which] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
                held.append(own.pairs[at])
                size, n = size + int(offsets[hi] - offsets[lo]), n + hi - lo
                if size >= block_bytes:
                    yield closed()
                    turn, held, size, n = turn + 1, [], 0, 0
        if held:
            yield closed()

    return block


def lister(batches):
    """A row for each distinct pair of a block."""
    for batch in batches:
        for block, pairs, counts in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            listed = np.frombuffer(zlib.decompress(pairs), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(listed), block)), pa.array(listed), pa.array(from_slim(counts))], ["block", "pair", "n"])


def summer(schema: pa.Schema):
    """A block's rows with the counts of its pairs: sums by text."""

    def total(rows: pa.Table, known: pa.Table) -> pa.Table:
        own = rows.filter(pc.equal(rows["no"], -1))
        texts = rows.filter(pc.not_equal(rows["no"], -1))
        order = np.argsort(known["pair"].to_numpy())
        at = order[np.searchsorted(known["pair"].to_numpy(), np.frombuffer(zlib.decompress(own["pairs"][0].as_py()), "<i8"), sorter=order)]
        places = from_slim(own["places"][0].as_py())
        texts = texts.sort_by("no")
        edges = np.concatenate(([0], np.cumsum(texts["n_links"].to_numpy())))
        # sums of whole numbers up to each text's end, so texts without links need no care
        upto = [np.concatenate(([0], np.cumsum(known[c].to_numpy().astype(np.int64)[at][places])))[edges] for c in ("total", "best")]
        count_sum, n_best = np.diff(upto[0]), np.diff(upto[1])
        out = {c: texts[c] for c in ("id", *COUNTS, "groups_sha256")} | {"n_best": n_best, "count_sum": count_sum}
        return pa.Table.from_arrays([out[f.name] if isinstance(out[f.name], pa.ChunkedArray) else pa.array(out[f.name]) for f in schema], schema=schema)

    return total


def _files(spark: SparkSession, paths: tuple[str, str]) -> tuple:
    """The vocabularies' bytes, sent to the tasks once."""
    out = []
    for path in paths:
        with open(path, "rb") as f:
            out.append(spark.sparkContext.broadcast(f.read()))
    return tuple(out)


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = (BYTE_BPE, PIECE_BPE)) -> DataFrame:
    """Per row: id, the ids of both tokenizers, their groups within the text, and the links as places in the two rows of ids."""
    files, kind = _files(docs.sparkSession, paths), dict(docs.dtypes)[id_col]

    def work(batches):
        a, b = byte_level(files[0].value), pieced(files[1].value)
        for batch in batches:
            _, offsets = text_arrays(batch.column("text"))
            for lo, hi in pieces(offsets, PIECE):
                own = Aligned(pc.fill_null(batch.column("text").slice(lo, hi - lo), "").to_pylist(), a, b)
                groups = np.concatenate(([0], np.cumsum(own.n_groups)))[:-1]
                links = np.concatenate(([0], np.cumsum(own.n_links)))

                def rows(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo), rows(own.a, own.bounds_a), rows(own.b, own.bounds_b),
                        rows(own.group_a - np.repeat(groups, np.diff(own.bounds_a)), own.bounds_a), rows(own.group_b - np.repeat(groups, np.diff(own.bounds_b)), own.bounds_b),
                        rows(own.link_a - own.bounds_a[own.link_text], links), rows(own.link_b - own.bounds_b[own.link_text], links),
                    ],
                    ["id", "a", "b", "group_a", "group_b", "link_a", "link_b"],
                )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ints = ", ".join(f"{c} array<int>" for c in ("a", "b", "group_a", "group_b", "link_a", "link_b"))
    return slim.mapInArrow(work, f"id {kind}, {ints}").withColumnRenamed("id", id_col)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = (BYTE_BPE, PIECE_BPE), block_bytes: int = 8 << 20, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """Per row: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; and the links of each id pair: pair, a, b, total, best.

    best: no other pair of b has more links. salts: shares that a pair's counts are summed in first.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, tables, kind = docs.sparkSession, Tables(docs.sparkSession, "alignment"), dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    layout = BLOCKS.format(kind=kind)
    made = spark.createDataFrame([], layout).schema
    blocks = tables.put(slim.mapInArrow(blocker(_files(spark, paths), to_arrow_schema(made), block_bytes), layout))
    asked = tables.put(blocks.where("no = -1").select("block", "pairs", "counts").mapInArrow(lister, "block bigint, pair bigint, n bigint"))
    salted = asked.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")).agg(F.sum("n").alias("n"))
    summed = tables.put(salted.groupBy("pair").agg(F.sum("n").alias("total")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = summed.groupBy(b.alias("b")).agg(F.max("total").alias("top"))  # as long as the second vocabulary at most
    counted = summed.withColumn("a", F.shiftright("pair", 32)).withColumn("b", b).join(F.broadcast(top), "b").select("pair", "a", "b", "total", (F.col("total") == F.col("top")).alias("best"))
    known = asked.select("block", "pair").join(counted.select("pair", "total", "best"), "pair")
    out = f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", groups_sha256 string, n_best bigint, count_sum bigint"
    schema = to_arrow_schema(spark.createDataFrame([], out).schema)
    rows = blocks.select("block", "no", "id", *COUNTS, "groups_sha256", "pairs", "places")
    done = rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(summer(schema), out)
    return done.withColumnRenamed("id", id_col), counted


def op12_token_alignment(spark, sf_dir):
    out, _ = align_tokens(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
