"""Fingerprints, token alignment and vector codes against plain versions, and their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

simhash = pytest.importorskip("civicspark.llm.simhash")
from civicspark.llm import token_alignment as ta  # noqa: E402
from civicspark.llm import vector_codes as vc  # noqa: E402

SF = "/root/testdata/sf0.01"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- fingerprints


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(f, bits=4):
    """The least number of each fingerprint's component, by all pairs."""
    f = np.array(f, np.uint64)
    label = np.arange(len(f))
    while True:
        new = np.array([label[np.bitwise_count(f ^ x) <= bits].min() for x in f])
        if (new == label).all():
            return label
        label = new


def test_fingerprints_and_components_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r[0]: (r[1], r[2]) for r in simhash.op11_simhash(spark, SF).collect()}
    prints = [plain_fingerprint(r["text"]) for r in rows]
    comps = plain_components(prints)
    assert got == {r["doc_id"]: (f"{p:016x}", rows[c]["doc_id"]) for r, p, c in zip(rows, prints, comps, strict=True)}


@pytest.mark.parametrize("cell", [2, 7, 2048])
def test_crowded_lists_are_split_without_loss(spark, cell):
    """Fingerprints around a few centres: lists of all levels, and chunks where a list stays large."""
    from civicspark.llm.common import Tables

    rng = np.random.default_rng(3)
    f = set()
    for centre in rng.integers(0, 2**63, 6, dtype=np.uint64).tolist():
        for _ in range(60):
            x = centre
            for b in rng.choice(24, rng.integers(0, 5), replace=False).tolist():  # in three bytes only, so five are shared
                x ^= 1 << b
            f.add(x)
    f = np.array(sorted(f), np.uint64)
    entries = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "f bigint")
    found = {r["k"]: r["c"] for r in simhash.link_fingerprints(entries, Tables(spark, "t"), 4, cell).collect()}
    label = plain_components(f)
    own = np.array([found.get(int(x), int(x)) for x in f.view(np.int64)])
    assert len(set(zip(label.tolist(), own.tolist(), strict=True))) == len(set(label.tolist())) == len(set(own.tolist()))


@pytest.mark.parametrize("bits", range(7))
def test_position_sets_cover_every_minimum(bits):
    from itertools import combinations

    levels = simhash.position_sets(bits)
    for level in levels:
        assert all(any(set(s) <= set(c) for s in level) for c in combinations(range(8), 8 - bits))


def test_tally_and_verification_agree_with_all_bits():
    x = np.random.default_rng(1).integers(0, 2**64, 4000, dtype=np.uint64)
    x[:2000] = 1 << np.random.default_rng(2).integers(0, 64, 2000).astype(np.uint64)
    assert (simhash.close(x, 4) == (np.bitwise_count(x) <= 4)).all()


def test_fingerprint_edges(spark):
    long = " ".join(f"w{i % 997}" for i in range(70_000))
    rows = [(3, None), (1, ""), (2, " \t"), (None, "One two"), (5, "one\x0btwo"), (5, "one\x0btwo"), (7, long), (None, "alone in here, quite"), (8, "a b c d"), (9, "A  B\nC D")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, f string, label int")
    got = Counter(map(tuple, simhash.simhash_duplicates(df).collect()))
    word = lambda t: f"{plain_fingerprint(t):016x}"
    assert got == Counter([(3, "0" * 16, 1), (1, "0" * 16, 1), (2, "0" * 16, 1), (None, word("one two"), 5), (5, word("one two"), 5), (5, word("one two"), 5), (7, word(long), 7), (None, word("alone in here, quite"), None), (8, word("a b c d"), 8), (9, word("a b c d"), 8)])
    assert simhash.simhash_duplicates(df.limit(0)).count() == 0


# ---- alignment


def plain_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(ta.BYTE_BPE)
    one.encode_special_tokens = True
    two, letters = SentencePieceProcessor(model_file=ta.PIECE_BPE), ta.byte_letters()
    docs, counts = [], Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        coded = one.encode(" " + (text or ""), add_special_tokens=False)
        a, b = coded.ids, two.encode(text or "")
        bytes_a = [bytes(letters[c] for c in t) for t in coded.tokens]
        bytes_b = [bytes([int(two.id_to_piece(j)[1:-1], 16)]) if two.is_byte(j) else two.id_to_piece(j).replace("▁", " ").encode() for j in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a, b, bytes_a, bytes_b = [], [], [], []
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(end_a) & set(end_b))
        links = [(a[end_a.index(c)], b[end_b.index(c)]) for c in cuts]
        groups = ["|".join(",".join(str(t) for t, e in zip(ids, ends, strict=True) if lo < e <= hi) for ids, ends in ((a, end_a), (b, end_b))) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        counts.update(links)
        docs.append((i, a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, len(a), len(b), len(g), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, ls in docs]


def aligned(df, **options):
    out, _ = ta.align_tokens(df, **options)
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in out.collect())


@pytest.mark.parametrize("block_bytes", [1, 8 << 20])
def test_alignment_equals_a_plain_version(spark, block_bytes):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert aligned(df, block_bytes=block_bytes, salts=3) == Counter(plain_alignment(rows))


def test_alignment_edges(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> <s></s> <0x41> <unk>"), (5, "a\tb\n\nc  d\x00"), (None, "naïve 東京 👩‍👩‍👧 é"), (7, "a▁b"), (8, "again again"), (8, "again again"), (9, "  lead"), (10, "x" * 3000), (11, "mot " * 3000)]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id int, text string, block int, pair string")
    got = aligned(df)
    assert got == Counter(plain_alignment(rows))
    assert got[(1, 0, 0, 0, 0, 0, 0, "")] == got[(7, 0, 0, 0, 0, 0, 0, "")] == 1 and got.total() == len(rows)
    assert not aligned(df.limit(0))


def test_links_where_several_tokens_end_together():
    """Tokens of no bytes: two of one tokenizer and three of the other at one place are six links."""
    cuts, group_a, group_b, link_a, link_b = ta.common_cuts(np.array([2, 4, 4]), np.array([1, 4, 4, 4]))
    assert cuts.tolist() == [4] and not group_a.any() and not group_b.any()
    assert sorted(zip(link_a.tolist(), link_b.tolist(), strict=True)) == [(i, j) for i in (1, 2) for j in (1, 2, 3)]


def test_alignments_of_a_text(spark):
    df = spark.createDataFrame([(1, "Tokenizers disagree, somewhat."), (2, None)], "doc_id int, text string")
    row, none = ta.alignments(df).orderBy("doc_id").collect()
    assert len(row["a"]) == len(row["group_a"]) and max(row["group_a"]) == max(row["group_b"]) == len(row["link_a"]) - 1
    assert [row["group_a"][i] for i in row["link_a"]] == [row["group_b"][i] for i in row["link_b"]] == list(range(len(row["link_a"])))
    assert none["a"] == none["link_b"] == []


# ---- codes


def test_codes_equal_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, vc.op13_vector_codes(spark, SF).collect())) == sorted(duckdb.sql(vc.ORACLE_SQL).fetchall())


def plain_books(x, parts, entries, rounds):
    """All distances in every round."""
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((x[:, p, None, :] - books[p][None]) ** 2).sum(-1).argmin(1) for p in range(parts)], 1)
    for _ in range(rounds):
        code, old = nearest(), books.copy()
        for p in range(parts):
            for e in range(len(books[p])):
                own = x[code[:, p] == e, p]
                books[p][e] = own.sum(0) // len(own) if len(own) else old[p][e]
    return nearest(), books


@pytest.mark.parametrize(("scale", "rounds"), [(2, 5), (3, 3), (256, 4)])
def test_pruned_rounds_equal_all_distances(spark, scale, rounds):
    """Coarse numbers make many ties and equal entries."""
    rng = np.random.default_rng(scale)
    v = rng.normal(size=(700, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), None) for i, r in enumerate(v)], "vec_id int, embedding array<float>, label int")
    rows, books = vc.code_vectors(df, parts=4, entries=24, rounds=rounds, scale=scale)
    code, want = plain_books(np.floor(v.astype(np.float64) * scale).astype(np.int64), 4, 24, rounds)
    assert (books == want).all()
    assert {r["id"]: r["code"] for r in rows.collect()} == {i: bytes(c.tolist()).hex() for i, c in enumerate(code)}


def test_bounds_leave_out_distances():
    rng = np.random.default_rng(5)
    books = rng.integers(-900, 900, (64, 4))
    x = books[rng.integers(0, 64, 3000)] + rng.integers(-20, 20, (3000, 4))
    code, d, lower = vc.first_codes(x, books)
    after = books + rng.integers(-3, 4, books.shape)
    moved = np.sqrt(vc.squares(after, books).astype(float))
    code, d, lower, measured = vc.next_codes(x, after, moved, code, np.sqrt(d), lower)
    every = np.stack([vc.squares(x, e) for e in after], 1)
    assert (code == every.argmin(1)).all() and (d == every.min(1)).all() and measured < 0.2 * every.size
    assert (lower <= np.sqrt(every)).all()


def test_code_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0] * 16, 1), (1, [0.0] * 16, None), (None, [-0.001] * 16, None), (3, None, 1), (4, [nan] * 16, 1), (5, [inf] * 16, 1), (6, [None] * 16, 1), (7, [], 1), (8, [1.0] * 15, 1), (9, [0.5] * 16, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id int, embedding array<float>, label int, code string")
    got, books = vc.code_vectors(df, entries=3)
    assert Counter((r["id"], r["label"]) for r in got.collect()) == Counter([(1, 1), (1, None), (None, None), (9, 1)])
    assert books.shape == (16, 3, 1) and books[0].ravel().tolist() == [-1, 0, 128]  # equal entries: the second kept no vector, the first took the null id's
    empty, none = vc.code_vectors(df.limit(0))
    assert empty.count() == 0 and none.size == 0
    with pytest.raises(Exception, match="exactly"):
        vc.code_vectors(spark.createDataFrame([(1, [1e9] * 16, 1)], "vec_id int, embedding array<float>, label int"))
