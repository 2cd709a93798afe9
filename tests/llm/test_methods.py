"""The methods of single operators against independent versions, and edge cases."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civicspark.llm import decontaminate, html_text, mixing, secrets, toxicity
from civicspark.storage import shared_dir

# ---- mixing


def cdf(n, g, d):
    w = {x: math.comb(g, x) * math.comb(n - g, d - x) for x in range(max(0, d + g - n), min(g, d) + 1)}
    total, out, run = math.comb(n, d), [], 0
    for x, v in w.items():
        run += v
        out.append((x, run / total))
    return out


@pytest.mark.parametrize("case", [(20, 7, 9), (1, 1, 0), (1, 1, 1), (500, 3, 250), (500, 497, 250), (3000, 1500, 1499), (40, 40, 13), (40, 0, 13), (9000, 20, 8990)])
def test_draws_invert_the_exact_distribution(spark, case):
    rng = random.Random(1)
    us = [rng.random() for _ in range(60)] + [1e-9, 1 - 1e-9]
    rows = spark.createDataFrame([(*case, u) for u in us], "n long, g long, d long, u double")
    got = [r["x"] for r in rows.selectExpr(f"{mixing.hypergeometric('n', 'g', 'd', 'u')} AS x").collect()]
    exact = cdf(*case)
    for u, x in zip(us, got, strict=True):
        want = next(k for k, p in exact if p >= u or k == exact[-1][0])
        assert x == want or min(abs(p - u) for _, p in exact) < 1e-9


def test_large_draws_have_the_right_moments(spark):
    n, g, d = 400_000_000, 130_000_000, 200_000_000
    rows = spark.range(150).selectExpr(f"{n}L AS n", f"{g}L AS g", f"{d}L AS d", "(id + 0.5D) / 150 AS u")
    got = np.array([r["x"] for r in rows.selectExpr(f"{mixing.hypergeometric('n', 'g', 'd', 'u')} AS x").collect()], float)
    mean = d * g / n
    sd = math.sqrt(mean * (1 - g / n) * (n - d) / (n - 1))
    assert abs(got.mean() - mean) < 0.02 * sd and 0.95 < got.std() / sd < 1.02 and (np.diff(got) >= 0).all()


def test_shards_of_the_tree_meet_every_quota(spark):
    quotas = {1: 1000, 2: 37, 3: 0, 4: 5}
    ends = {r["source_no"]: r["ends"] for r in mixing.shard_ends(spark.createDataFrame(list(quotas.items()), "source_no int, blocks long"), 3, 7).collect()}
    assert all(len(e) == 8 and e == sorted(e) and e[-1] == quotas[s] for s, e in ends.items())
    sizes = np.sum([np.diff([0, *e]) for e in ends.values()], 0)
    assert sizes.sum() == 1042 and sizes.max() - sizes.min() <= 3
    share = np.diff([0, *ends[1]])
    assert 100 <= share.min() and share.max() <= 150


def test_mixing_of_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(None, "a b", None)] * 3 + [(1, "c d e", "s")] * 2 + [(2, None, "s")], "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix_sources(df).collect()
    assert len(got) == 6 and sum(r["taken"] for r in got) == pytest.approx(1.5 * 12, abs=3)
    assert {r["source_size"] for r in got} == {6}


# ---- secrets


def test_bare_tokens_of_all_encodings_are_found(spark):
    rng = random.Random(3)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = [upper + lower + digit, upper + lower + digit + "+/", upper + lower + digit + "-_", upper + lower + digit + "+/-_", "0123456789ABCDEF", upper + lower]
    rows = [(i, f"see {''.join(rng.choice(kinds[i % 6]) for _ in range(40))} here") for i in range(300)]
    rows += [(1000 + i, "an-ordinary-and-rather-long-compound/of/words_in_a_path Donaudampfschifffahrtsgesellschaft " * 2) for i in range(100)]
    key = "".join(rng.choice(kinds[0]) for _ in range(44))
    rows.append((2000, f"xxx{'ab01' * 5}{key}"))  # a hex span, and what is left of the token after it
    got = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [sum(len(got[i]["spans"]) > len(got[i]["base_spans"]) for i in range(k, 300, 6)) for k in range(6)]
    assert min(found) >= 45, found
    assert not any(got[1000 + i]["spans"] for i in range(100))
    left = [(x["s"], x["e"]) for x in got[2000]["spans"] if x["k"] == 3]
    assert left and left[0][0] >= 23 and left[0][1] == 23 + 44


# ---- toxicity


def test_label_model_finds_rates_and_shares_the_weight_of_copies():
    rng = np.random.default_rng(5)
    y = rng.random(6000) < 0.2
    rate1, rate0 = np.array([0.6, 0.5, 0.4, 0.3, 0.05]), np.array([0.02, 0.03, 0.01, 0.02, 0.3])
    votes = np.where(y[:, None], rng.random((6000, 5)) < rate1, rng.random((6000, 5)) < rate0).astype(float)
    noisy = np.where(rng.random(6000) < 0.05, ~y, y).astype(float)
    post = toxicity.label_model(votes, noisy, 4)

    def auc(x):
        ranks = np.argsort(np.argsort(x + rng.random(len(x)) * 1e-9))
        return (ranks[y].mean() - (y.sum() - 1) / 2) / (~y).sum()

    assert auc(post) > auc(noisy) + 0.005
    # ten copies of one weak voter don't outvote the others
    copied = np.concatenate([votes[:, :4], np.repeat(votes[:, 4:], 10, 1)], 1)
    assert abs(auc(toxicity.label_model(copied, noisy, 4)) - auc(post)) < 0.01


def test_toxicity_of_repeated_and_null_rows(spark):
    rows = [(i, f"wort{i % 7} idiot" if i % 4 == 0 else f"wort{i % 7} haus") for i in range(80)] + [(None, "idiot"), (None, None), (3, "haus"), (3, "haus")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(out) == 84 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 3}) == 1  # no voter speaks in either of its texts


# ---- decontamination


def test_begins_and_ends_are_those_of_an_alignment():
    rng = random.Random(8)
    for _ in range(200):
        item = "".join(rng.choice("abcdefgh ") for _ in range(60))
        own = list(item)
        for _ in range(3):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "zz"])
        lead = "".join(rng.choice("xyw") for _ in range(rng.randint(0, 30)))
        text = np.frombuffer((lead + "".join(own) + "qqqqq").encode(), np.uint8)
        want = np.frombuffer(item.encode(), np.uint8)
        got = decontaminate.aligned(want, text, max(0, len(lead) - 3), len(lead) + 3, 8)
        edits, first, end = got
        row = list(range(len(text[first:end]) + 1))
        for x in want:
            new = [row[0] + 1]
            for j, z in enumerate(text[first:end], 1):
                new.append(min(row[j - 1] + (x != z), row[j] + 1, new[-1] + 1))
            row = new
        assert row[-1] == edits  # the whole item against just this stretch


def test_repeated_characters_need_little_memory(spark):
    docs = spark.createDataFrame([(1, "a" * 30_000), (2, "ab " * 500), (3, "b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a" * 800)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"], r["end"] - r["first"]) for r in got] == [(1, 7, 0, 800)]


# ---- main text


def built(rng):
    """A page of known parts, and the text of its article."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    prose = lambda n: ", ".join(" ".join(word() for _ in range(6)) for _ in range(n)) + "."
    parts, text = [], []
    for _ in range(rng.randint(3, 7)):
        p = prose(rng.randint(2, 5))
        text.append(p)
        parts.append(f"<{(t := rng.choice(['p', 'blockquote']))}>{p.replace(',', rng.choice([',', ',<b></b>', ', ']))}</{t}>")
    links = "".join(f"<li><a href='/{word()}'>{word()}, {word()}</a></li>" for _ in range(8))
    around = [f"<nav><ul>{links}</ul></nav>", f"<div class='sidebar'><p>{prose(4)}</p></div>", f"<footer><p>{prose(2)}</p></footer>", f"<div id='comments'><p>{prose(5)}</p></div>", f"<form><p>{prose(3)}</p></form>", f"<div class='ad'>{prose(3)}</div>", f"<script>var a = '{prose(2)}';</script>", f"<!-- {prose(2)} -->"]
    rng.shuffle(around)
    inner = f"<{(b := rng.choice(['article', 'main', 'div class=content']))}>" + "\n".join(parts) + f"</{b.split()[0]}>"
    at = rng.randint(0, len(around))
    page = "<html><body>" + "".join(around[:at]) + inner + "".join(around[at:]) + "</body></html>"
    return page, " ".join(text)


def test_articles_of_built_pages():
    rng = random.Random(12)
    for _ in range(150):
        page, text = built(rng)
        assert html_text.main_text(page) == text


def test_pages_repeated_empty_and_deep(spark):
    page, text = built(random.Random(1))
    df = spark.createDataFrame([(1, "u", page)] * 3 + [(None, None, "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("id", F.lit(0))
    got = html_text.extract_text(df).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, "x")] + [(1, text)] * 3
    assert html_text.extract_text(df.limit(0)).count() == 0
    began = time.perf_counter()
    assert html_text.main_text("<div>" * 60_000 + "</p></b></li>" * 20_000 + "<p>One, two, and three words of a text.") == "One, two, and three words of a text."
    assert time.perf_counter() - began < 10


# ---- tables between steps


def test_shared_folder_is_asked_for(spark):
    assert shared_dir(spark)
    assert decontaminate.grams(np.zeros(3, np.uint8), 12).size == 0 and pa.__version__
