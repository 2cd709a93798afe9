"""Search queries as boolean Columns over a row's terms.

Two grammars: the web style (words are ANDed, "a phrase", or, -not; never an error) and the expression style
(AND, OR, NOT, parentheses, "a phrase", prefix*, NEAR(a "b c", 5), a NEAR/5 b). A query is parsed on the driver into a Column; nothing is joined.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def near(begins: list[Column], lengths: list[int], most: int) -> Column:
    """Whether some places, one of each list, lie together: the last phrase begins at most `most` words after the end of each other.

    The lists are merged in order and walked once; at each place the last ones of all other lists are the nearest.
    """
    def place(who: int):
        return lambda p: F.struct(p.cast("int").alias("at"), F.lit(who).alias("who"), (p + lengths[who]).cast("int").alias("end"))

    marked = [F.transform(b, place(i)) for i, b in enumerate(begins)]
    start = F.struct(F.array(*[F.lit(-1)] * len(begins)).alias("ends"), F.lit(False).alias("found"))

    def step(state, e):
        ends = F.transform(state["ends"], lambda x, j: F.when(j == e["who"], e["end"]).otherwise(x))
        first = F.array_min(ends)
        return F.struct(ends.alias("ends"), (state["found"] | ((first >= 0) & (e["at"] - first <= most))).alias("found"))

    return F.aggregate(F.array_sort(F.concat(*marked)), start, step, lambda s: s["found"])


@dataclass(frozen=True)
class Terms:
    """A row's terms as an array column."""

    tokens: Column

    def word(self, term: str) -> Column:
        return F.array_contains(self.tokens, term)

    def phrase(self, terms: list[str]) -> Column:
        line = F.concat(F.lit(" "), F.array_join(self.tokens, " "), F.lit(" "))
        return F.contains(line, F.lit(f" {' '.join(terms)} "))

    def near(self, phrases: list[list[str]], most: int) -> Column:
        def places(word: str, back: int) -> Column:
            found = F.transform(self.tokens, lambda t, i: F.when(t == word, i - back))
            return F.filter(found, lambda p: p.isNotNull())

        def begins(terms: list[str]) -> Column:
            out = places(terms[0], 0)
            for i, t in enumerate(terms[1:], 1):
                out = F.array_intersect(out, places(t, i))
            return out

        return near([begins(p) for p in phrases], [len(p) for p in phrases], most)

    def prefix(self, start: str) -> Column:
        return F.exists(self.tokens, lambda t: F.startswith(t, F.lit(start)))


def fold(text: str) -> list[str]:
    """A query's words as `simple_tokens` would give them."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def _all(parts: list[Column]) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def plain_query(terms: Terms, text: str, words: Callable[[str], list[str]] = fold) -> Column:
    """All words; a query without words matches nothing."""
    out = _all([terms.word(w) for w in dict.fromkeys(words(text))])
    return F.lit(False) if out is None else out


def web_query(terms: Terms, text: str, words: Callable[[str], list[str]] = fold) -> Column:
    """The web style: `or` binds weaker than the implied AND; a lone quote is ignored."""
    groups: list[list[Column]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        if not quoted and word.lower() == "or" and not minus:
            if groups[-1]:
                groups.append([])
            continue
        found = words(quoted or word)
        if not found:
            continue
        hit = terms.phrase(found) if len(found) > 1 else terms.word(found[0])
        groups[-1].append(~hit if minus else hit)
    out = None
    for g in groups:
        both = _all(g)
        if both is not None:
            out = both if out is None else out | both
    return F.lit(False) if out is None else out


#: Words between phrases that NEAR allows where none are given.
NEAR = 10


class _Expression:
    """OR over AND over NOT over a word, phrase, prefix, nearness or parenthesis."""

    def __init__(self, terms: Terms, text: str) -> None:
        self.terms, self.at = terms, 0
        self.parts = re.findall(r'"[^"]*"\*?|\(|\)|[^\s()"]+', text)

    def peek(self) -> str | None:
        return self.parts[self.at] if self.at < len(self.parts) else None

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "OR":
            self.at += 1
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while (p := self.peek()) is not None and p not in ("OR", ")"):
            negate = p == "NOT"
            if p in ("AND", "NOT"):
                self.at += 1
            nxt = self.one()
            out = out & (~nxt if negate else nxt)
        return out

    def one(self) -> Column:
        p = self.peek()
        if p is None or p in ("AND", "OR", "NOT", ")"):
            raise ValueError(f"a term is missing at part {self.at}")
        self.at += 1
        if p == "NEAR" and self.peek() == "(":
            return self.group()
        out, chain = self.single(p), 0
        while (q := self.peek()) is not None and (m := re.fullmatch(r"NEAR(?:/(\d+))?", q)) and self.parts[self.at + 1 : self.at + 2] not in ([], ["("], [")"]):
            other = self.parts[self.at + 1]
            if p == "(" or p.endswith("*") or other.endswith("*") or not fold(p) or not fold(other):
                raise ValueError(f"{q} stands between two words or phrases")
            self.at += 2
            pair = self.terms.near([fold(p), fold(other)], int(m[1]) if m[1] else NEAR) if fold(p) != fold(other) else self.single(other)
            out, p = (pair if chain == 0 else out & pair), other
            chain += 1
        return out

    def group(self) -> Column:
        """NEAR(a "b c" d, 5): all of them within so many words."""
        inside, most = [], NEAR
        self.at += 1
        while (p := self.peek()) is not None and p != ")":
            self.at += 1
            inside.append(p)
        if p is None:
            raise ValueError("a parenthesis is open")
        self.at += 1
        if len(inside) > 1 and inside[-1].isdigit() and (inside[-2].endswith(",") or inside[-2] == ","):
            most = int(inside.pop())
        elif inside and (m := re.fullmatch(r"(.*),(\d+)", inside[-1])):
            inside[-1], most = m[1], int(m[2])
        phrases = [w for w in dict.fromkeys(tuple(fold(x)) for x in inside) if w]
        if not phrases or any("*" in x for x in inside):
            raise ValueError("NEAR needs words or phrases")
        lists = [list(w) for w in phrases]
        return self.terms.near(lists, most) if len(lists) > 1 else self.terms.phrase(lists[0])

    def single(self, p: str) -> Column:
        if p == "(":
            out = self.either()
            if self.peek() != ")":
                raise ValueError("a parenthesis is open")
            self.at += 1
            return out
        words = fold(p)
        if not words:
            raise ValueError(f"no word in {p!r}")
        if p.endswith("*"):
            start = self.terms.prefix(words[-1])
            return start if len(words) == 1 else self.terms.phrase(words[:-1]) & start
        return self.terms.phrase(words) if len(words) > 1 else self.terms.word(words[0])


def expression_query(terms: Terms, text: str) -> Column:
    """The expression style; a malformed one is a ValueError."""
    parser = _Expression(terms, text)
    out = parser.either()
    if parser.peek() is not None:
        raise ValueError(f"unexpected {parser.peek()!r}")
    return out
