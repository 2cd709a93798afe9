"""URL rules, quality, HTML, secrets, toxicity, leaks and mixing on small cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicspark.llm import decontaminate, html_text, mixing, quality, secrets, toxicity, url_rules

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("a.example.com", "", "allow")]


def fits(host, path):
    best = None
    for h, p, v in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best or (None, "allow")


def test_url_rules(spark):
    hosts = ["example.com", "A.Example.com", "b.a.example.com", "xexample.com", "example.net", "net", "org", "www.org", "", "com.", ".com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/7", "/en/8?x=/en/", "/de/81#y", "/es/", "?q", "/EN/7")] + [None, "", "no scheme", "a://b://c/en/", "x://example.com/en/71"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls * 3)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([(h, p, v) for h, p, v in RULES], "host string, path string, verdict string")
    for n in (1, 7):
        got = {r["page_id"]: r for r in url_rules.judge_urls(df, rules, ranges=n).collect()}
        assert len(got) == len(urls) * 3
        for i, u in enumerate(urls * 3):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            host = re.match(r"[^/?#]*", rest).group().lower()
            path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
            assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, *fits(host, path)), u
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0
    assert url_rules.judge_urls(df, rules.limit(0)).where("rule IS NOT NULL OR verdict <> 'allow'").count() == 0


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = ["", None, "a", "a b\na b\n\n a b", "x y z x y z x", "é # é\n# é", "\n\n", "q\n" * 400] + ["".join(rng.choice("ab c\n#") for _ in range(rng.randint(0, 400))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(60)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge_quality(df, labels).collect()}
    for i, t in enumerate(texts):
        want = counts_of(t)
        assert [got[i][c] for c in quality.COUNTS] == want, repr(t)
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert quality.judge_quality(df.limit(0), labels.limit(0)).count() == 0


def test_bounds_and_cutoffs():
    assert quality.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.binomial_upper(5, 5, 0.05) == 1.0
    bins = np.array([0, 10, 200])
    assert quality.safe_cutoff(bins, np.array([5000, 4000, 1]), 0.01, 0.05) == 11
    assert quality.safe_cutoff(bins, np.array([3, 0, 0]), 0.01, 0.05) is None
    rng = np.random.default_rng(0)
    lost = [(rng.geometric(0.05, 4000) >= (quality.safe_cutoff(*np.unique(np.minimum(rng.geometric(0.05, 3000), 255), return_counts=True), 0.02, 0.05) or 256)).mean() for _ in range(60)]
    assert np.mean(np.array(lost) > 0.02) <= 0.15


def test_junk_is_rejected_with_some_hundred_labels(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60))
    rows = [(i, text(), "en" if i % 2 else None) for i in range(1000)]
    rows += [(i, text() + " " + "#$% " * 12, "en" if i % 2 else None) for i in range(1000, 1060)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in rows[:1040]], "doc_id long, quality int")
    got = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    assert not any(r["base_failed"] for r in got)
    assert not any(r["kept"] for r in got if r["doc_id"] >= 1000)
    for lang in (0, 1):
        assert sum(not r["kept"] for r in got if r["doc_id"] < 1000 and r["doc_id"] % 2 == lang) <= 5


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Menu, one, two</a></li></ul></nav>
<header>Top</header><div class="ad">Buy, buy, buy this very long advert text, now, today.</div>
<article><h1>Title &amp; more</h1><p><b>First paragraph, with commas, and enough words to count as text.<br><p>Second   one,
with a break &#233; and a <a href=y>link</a>, plus words, and more words.</p><blockquote>Quoted, said they.</blockquote><p>Short.</article>
<aside>Related, things, here, and there, and everywhere else too.</aside><div id="comments"><p>I disagree, strongly, with all of this, and more, and more.</p></div>
<form>Sign up, now, please</form><footer>&copy; foot, er, text, long enough to be counted as prose.</footer></body></html>"""


def test_html_main_text(spark):
    want = "Title & more First paragraph, with commas, and enough words to count as text. Second one, with a break é and a link, plus words, and more words. Quoted, said they. Short."
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<<a <b>x < y & z"), (5, "u", "<script>x"), (6, "u", "<p>a" * 3000)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()}
    assert got[1] == (want, len(want))
    assert got[2] == got[3] == got[5] == ("", 0)
    assert "y & z" in got[4][0] and got[6][0].split() == ["a"] * 3000


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets(spark):
    rng = random.Random(5)
    key = lambda n, abc: "".join(rng.choice(abc) for _ in range(n))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [None, "", f'password = "{key(20, b64)}" x', f"Token:{key(5, b64)} token=secret={key(20, b64)}", f"é😀 {key(32, hexa)} AKIA{key(16, 'ABCDEF012345')}", "token=password: " + "longvalue12345", f"\u0001 api_key='{key(14, hexa)}'\u0002", "AKIAAKIA" + "Z" * 20]
    texts += [f"{key(40, b64)} word {key(44, b64)}" for _ in range(20)] + ["a-perfectly-ordinary-compound-word-2 in/a/path/of/some/length/v1"] * 5
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in secrets.find_secrets(df).select("doc_id", F.expr(secrets.span_list("base_spans")).alias("b"), F.sha2(F.expr(secrets.span_list("base_spans")).cast("binary"), 256).alias("h"), F.expr(secrets.span_list("spans")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["b"] == base_spans(t), t
        assert got[i]["h"] == hashlib.sha256(base_spans(t).encode()).hexdigest()
        assert set(filter(None, got[i]["b"].split(","))) <= set(got[i]["s"].split(","))
    assert sum("random:" in got[i]["s"] for i in range(8, 28)) >= 15
    assert not any("random:" in got[i]["s"] for i in range(28, 33))
    blank = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert blank[2] == '[secret]" x' and blank[0] is None
    assert secrets.redact(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    plain = [f"mot{i}" for i in range(200)]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = int(i % 6 == 0)
        if toxic:
            words[rng.randrange(30)] = rng.choice(["idiot", "grumble" + str(i % 9), "zorkish"])
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.97
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and 0 <= got[1000]["score"] <= 1
    assert toxicity.score_toxicity(df.limit(0), labels.limit(0)).count() == 0


def edits(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    syl = ["the", "an", "er", "tion", "qu", "os", "ment", "é"]
    text = lambda n: " ".join("".join(rng.choice(syl) for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [text(rng.randint(12, 40)) for _ in range(25)] + ["short", "", None]
    norm = lambda t: re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", (t or "").encode().lower()).strip()
    docs = []
    for i in range(60):
        body = text(rng.randint(0, 80))
        if i % 2:
            own = list(items[i % 25].upper() if i % 3 else items[i % 25])
            for _ in range(i % 8):
                own[rng.randrange(len(own))] = rng.choice(["", "x", "yy"])
            body += ". " + "".join(own).replace(" ", ",\n") + "! " + text(10)
        docs.append(body)
    docs += [None, "", items[0], items[0] * 2]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, item long")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, t in enumerate(docs):
        for j, it in enumerate(items):
            m = norm(it)
            if len(m) >= 12 and edits(m, norm(t)) <= min(int(0.05 * len(m)), (len(m) - 12) // 12):
                want.add((i, j))
    for options in ({}, {"slice_bytes": 500}):
        got = decontaminate.find_leaks(d, b, **options).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 10
    assert {r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()} == set(range(len(docs))) - {i for i, _ in want}


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 60), ["a", "b", "c", "d", None][min(4, int(rng.random() ** 2 * 6))]) for i in range(900)] + [(900, None, "a"), (901, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(1))
    one = {r["doc_id"]: r for r in mixing.mix_sources(df, block_words=200).collect()}
    two = {r["doc_id"]: r for r in mixing.mix_sources(df.repartition(7), block_words=200).collect()}
    assert one == two and len(one) == len(rows)
    sizes, weights = Counter(), {}
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (5, 2, 1)[i % 3]
    want, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s], left = 2.0 * sizes[s], left - 2.0 * sizes[s]
        open_ -= full
    want |= {s: level * weights[s] for s in open_}
    taken, shards = Counter(), Counter()
    for i, t, s in rows:
        r = one[i]
        assert r["size"] == len((t or "").split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and len(r["draws"]) == r["copies"]
        taken[s] += r["taken"]
        shards.update(x["shard"] for x in r["draws"])
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert set(shards) == set(range(8))
    assert mixing.mix_sources(df.limit(0)).count() == 0
    drawn = mixing.draw_mix(df, block_words=200)
    assert drawn.count() == sum(r["copies"] for r in one.values())
