"""The French suffix stemmer of the Snowball collection, as its public description gives it: suffixes go by the regions of a word.

RV begins after the first vowel that isn't the first letter (after the third letter where a word begins with two vowels or one of three
beginnings); R1 after the first non-vowel that follows a vowel, R2 likewise within R1. Vowels that act as consonants are capitals while a word
is worked on. Words are stemmed once a batch, however often they occur.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import ACCENTED, UNACCENTED

# The letters and suffixes of the public description.
VOWELS = "aeiouyâàëéêèïîôûù"
#: Suffixes that go where they lie in a region, by the rule that handles them.
SUFFIXES = {
    "drop": "ance iqUe isme able iste eux ances iqUes ismes ables istes",
    "ator": "atrice ateur ation atrices ateurs ations",
    "logie": "logie logies",
    "usion": "usion ution usions utions",
    "ence": "ence ences",
    "ement": "ement ements",
    "ite": "ité ités",
    "if": "if ive ifs ives",
    "eaux": "eaux",
    "aux": "aux",
    "euse": "euse euses",
    "issement": "issement issements",
    "amment": "amment",
    "emment": "emment",
    "ment": "ment ments",
}
I_VERBS = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"

RULE = {s: rule for rule, some in SUFFIXES.items() for s in some.split()}
VERB = {s: "e" for s in E_VERBS.split()} | {s: "a" for s in A_VERBS.split()} | {"ions": "ions"}
I_VERB = set(I_VERBS.split())
LONGEST = 10


def _after(word: str, begin: int) -> int:
    """The end of the first non-vowel after a vowel from `begin` on."""
    m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, begin)
    return m.end() if m else len(word)


def regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    if re.match(f"[{VOWELS}]{{2}}|par|col|tap", word):
        rv = min(3, len(word))
    else:
        m = re.compile(f"[{VOWELS}]").search(word, 1)
        rv = m.end() if m else len(word)
    r1 = _after(word, 0)
    return rv, r1, _after(word, r1)


def _longest(word: str, suffixes, begin: int = 0) -> str:
    """The longest of some suffixes that lies at `begin` or after it."""
    for i in range(max(begin, len(word) - LONGEST), len(word)):
        if word[i:] in suffixes:
            return word[i:]
    return ""


class _Word:
    """A word and its regions; `end` tells whether a suffix is there and where it begins."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.rv, self.r1, self.r2 = regions(text)

    def cut(self, suffix: str, region: int, new: str = "") -> bool:
        """Replace a suffix that lies in a region; whether it did."""
        at = len(self.text) - len(suffix)
        if not self.text.endswith(suffix) or at < region:
            return False
        self.text = self.text[:at] + new
        return True


def _noun(w: _Word) -> tuple[bool, bool]:
    """The first step: whether a suffix went, and whether verbs' suffixes are still to be looked for."""
    s = _longest(w.text, RULE)
    rule = RULE.get(s, "")
    if rule == "drop":
        done = w.cut(s, w.r2)
    elif rule == "ator":
        done = w.cut(s, w.r2)
        if done and w.text.endswith("ic") and not w.cut("ic", w.r2):
            w.cut("ic", 0, "iqU")
    elif rule in ("logie", "usion", "ence"):
        done = w.cut(s, w.r2, {"logie": "log", "usion": "u", "ence": "ent"}[rule])
    elif rule == "ement":
        done = w.cut(s, w.rv)
        if done:
            if w.text.endswith("iv"):
                if w.cut("iv", w.r2):
                    w.cut("at", w.r2)
            elif w.text.endswith("eus"):
                w.cut("eus", w.r2) or w.cut("eus", w.r1, "eux")
            elif w.text.endswith(("abl", "iqU")):
                w.cut(w.text[-3:], w.r2)
            elif w.text.endswith(("ièr", "Ièr")):
                w.cut(w.text[-3:], w.rv, "i")
    elif rule == "ite":
        done = w.cut(s, w.r2)
        if done:
            for end, new in (("abil", "abl"), ("ic", "iqU"), ("iv", "iv")):
                if w.text.endswith(end):
                    w.cut(end, w.r2) or w.cut(end, 0, new)
                    break
    elif rule == "if":
        done = w.cut(s, w.r2)
        if done and w.cut("at", w.r2) and w.text.endswith("ic"):
            w.cut("ic", w.r2) or w.cut("ic", 0, "iqU")
    elif rule == "eaux":
        done = w.cut(s, 0, "eau")
    elif rule == "aux":
        done = w.cut(s, w.r1, "al")
    elif rule == "euse":
        done = w.cut(s, w.r2) or w.cut(s, w.r1, "eux")
    elif rule == "issement":
        done = len(w.text) > len(s) and w.text[-len(s) - 1] not in VOWELS and w.cut(s, w.r1)
    elif rule in ("amment", "emment"):
        return w.cut(s, w.rv, {"amment": "ant", "emment": "ent"}[rule]), True
    elif rule == "ment":
        at = len(w.text) - len(s) - 1
        return at >= w.rv and w.text[at] in VOWELS and w.cut(s, 0), True
    else:
        done = False
    return done, not done


def _verb(w: _Word) -> bool:
    s = _longest(w.text, I_VERB, w.rv)
    at = len(w.text) - len(s) - 1
    if s and at >= w.rv and w.text[at] not in VOWELS:
        return w.cut(s, 0)
    s = _longest(w.text, VERB, w.rv)
    if VERB.get(s) == "ions":
        return w.cut(s, w.r2)
    if not s or not w.cut(s, w.rv):
        return False
    if VERB[s] == "a":
        w.cut("e", w.rv)
    return True


def _rest(w: _Word) -> None:
    """What ends a word that kept its suffix."""
    if len(w.text) > 1 and w.text[-1] == "s" and w.text[-2] not in "aiouès":
        w.text = w.text[:-1]
    s = _longest(w.text, {"ion", "ier", "ière", "Ier", "Ière", "e"}, w.rv)
    if s == "ion":
        if len(w.text) - 4 >= w.rv and w.text[-4] in "st":
            w.cut(s, w.r2)
    elif s:
        w.cut(s, w.rv, "" if s == "e" else "i")


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    marked = re.sub(f"(?<=[{VOWELS}])([ui])(?=[{VOWELS}])|(?<=q)(u)", lambda m: m[0].upper(), word)
    marked = re.sub(f"y(?=[{VOWELS}])|(?<=[{VOWELS}])y", "Y", marked)
    w = _Word(marked)
    altered, verbs = _noun(w)
    if verbs:
        altered = _verb(w) or altered
    if altered:
        w.text = re.sub("ç$", "c", re.sub("Y$", "i", w.text))
    else:
        _rest(w)
    w.text = re.sub("(enn|onn|ett|ell|eill)$", lambda m: m[0][:-1], w.text)
    w.text = re.sub(f"[éè]([^{VOWELS}]+)$", r"e\1", w.text)
    return w.text.lower()


def _told(words: pa.Array, of: Callable[[str], str]) -> pa.Array:
    """Lists of words to lists of what is told of them, once for each distinct word of a batch."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    lengths = words.value_lengths().fill_null(0).to_numpy()
    flat = words.flatten().dictionary_encode()
    told = pa.array([of(w) for w in flat.dictionary.to_pylist()], pa.string())
    edges = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(edges, told.take(flat.indices))


@F.arrow_udf(ArrayType(StringType()))
def stems(words: pa.Array) -> pa.Array:
    """Lists of words to lists of stems; each distinct word of a batch is stemmed once."""
    return _told(words, stem)


#: What `text.unaccent` does to a word.
PLAIN = str.maketrans(ACCENTED, UNACCENTED, "".join(map(chr, range(0x300, 0x370))))


@F.arrow_udf(ArrayType(StringType()))
def stems_unaccented(words: pa.Array) -> pa.Array:
    """The same without accents."""
    return _told(words, lambda w: stem(w).translate(PLAIN))
