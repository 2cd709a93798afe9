"""Marks around the words of a query. Runs after the last limit, on the rows that are shown."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .stem import stems
from .text import unaccent


def highlight_one(text: str | None, query: str | None, context: int = 10, limit: int = 1000) -> str:
    """The stretch around the first word that begins with a query word, all such words in it marked.

    Up to `context` words on either side; the start of the text if nothing matches. Case is folded, accents are not.
    """
    text = text or ""
    words = [w for w in re.findall(r"\w+", (query or "").lower()) if len(w) >= 2]
    if not words:
        return text[:limit]
    any_word = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(set(words), key=len, reverse=True))) + r")\w*", re.I)
    first = any_word.search(text)
    if first is None:
        return text[:limit]
    before = list(re.finditer(r"\S+", text[: first.start()]))
    after = list(re.finditer(r"\S+", text[first.end() :]))
    lo = before[-context].start() if len(before) > context else 0
    hi = first.end() + (after[context - 1].end() if len(after) >= context else len(text) - first.end())
    return any_word.sub(lambda m: f"<mark>{m.group()}</mark>", text[lo:hi])


@F.pandas_udf(StringType())
def highlight_udf(text: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([highlight_one(t, q) for t, q in zip(text, query, strict=True)])


def headline(text: Column | str, terms: list[str]) -> Column:
    """Words that begin with a term, marked; built-in functions alone."""
    c = F.col(text) if isinstance(text, str) else text
    if not terms:
        return c
    either = "|".join(re.sub(r"([\\^$.|?*+(){}\[\]])", r"\\\1", t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(c, rf"(?iuU)\b((?:{either})\w*)", "<mark>$1</mark>")


def fragment(text: Column | str, terms: list[str], most: int = 18) -> Column:
    """One stretch of at most `most` words around the first word that a term begins, with such words marked; accents and case are folded.

    The stretch begins up to `most` // 2 words before that word, earlier where the text ends sooner; without a hit it is the text's start.
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    either = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    hit = lambda w: F.regexp_replace(unaccent(F.lower(w)), r"[^\p{L}\p{N}]", "").rlike(f"^(?:{either})") if terms else F.lit(False)
    flags = F.transform(words, hit)
    first = F.greatest(F.array_position(flags, True), F.lit(1))
    start = F.greatest(F.lit(1), F.least(first - most // 2, F.size(words) - (most - 1)))
    shown = F.transform(F.slice(words, start.cast("int"), F.lit(most)), lambda w: F.when(hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
    return F.array_join(shown, " ")


def best_fragment(text: Column | str, terms: list[str], most: int = 18, stemmed: bool = True) -> Column:
    """The stretch of at most `most` words with the best cover of the terms, all their words in it marked.

    The best cover has the most different terms within `most` words, then is the shortest, then the first. It is found in one walk over the words that
    hit: at each, the last place of every term tells the shortest cover that ends there. Shown are the cover and the words around it, as many on either
    side; without a hit the text's start. stemmed: terms are stems (`query_stems`) and words are stemmed to compare; else folded words.
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if not terms:
        return F.array_join(F.slice(F.filter(F.split(c, r"\s+"), lambda w: w != ""), 1, most), " ")
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    same = F.transform(stems(bare) if stemmed else bare, unaccent)
    own = F.array(*map(F.lit, terms))
    # one pass gives a row's words with the number of the term that each is, 0 for none
    marked = F.arrays_zip(words.alias("w"), F.transform(same, lambda k: F.array_position(own, k)).alias("k"))
    placed = F.transform(marked, lambda x, i: F.struct((i + 1).cast("int").alias("at"), x["w"].alias("w"), x["k"].cast("int").alias("k")))
    start = F.struct(F.array(*[F.lit(-most)] * len(terms)).alias("last"), F.struct(*[F.lit(0).alias(n) for n in ("n", "tight", "early")]).alias("best"))

    def step(state, x):
        last = F.transform(state["last"], lambda p, j: F.when(j + 1 == x["k"], x["at"]).otherwise(p))
        inside = F.filter(last, lambda p: p > x["at"] - most)
        begin = F.array_min(inside)
        found = F.struct(F.size(inside).alias("n"), (begin - x["at"]).alias("tight"), (-begin).alias("early"))
        return F.when(x["k"] == 0, state).otherwise(F.struct(last.alias("last"), F.greatest(state["best"], found).alias("best")))

    def shown(all_words: Column, best: Column) -> Column:
        begin, size = -best["early"], 1 - best["tight"]
        first = F.greatest(F.lit(1), F.least(begin - F.floor((most - size) / 2).cast("int"), F.size(all_words) - (most - 1)))
        first = F.when(best["n"] == 0, F.lit(1)).otherwise(first)
        return F.array_join(F.transform(F.slice(all_words, first, F.lit(most)), lambda x: F.when(x["k"] > 0, F.concat(F.lit("<mark>"), x["w"], F.lit("</mark>"))).otherwise(x["w"])), " ")

    # words and cover are bound one after the other, so that neither is made anew for each use
    bound = F.transform(F.array(placed), lambda p: F.struct(p.alias("words"), F.aggregate(p, start, step, lambda s: s["best"]).alias("best")))
    return F.transform(bound, lambda x: shown(x["words"], x["best"]))[0]
