"""Analyzers: text to search terms."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .match import fold
from .stem import stem, stems_unaccented
from .text import unaccent

TOKEN = r"[\p{L}\p{N}]+"

def stops_fr() -> list[str]:
    """Spark's French stop words."""
    return StopWordsRemover.loadDefaultStopWords("french")


def query_stems(text: str, unaccent_first: bool = False) -> list[str]:
    """A query's words as `analyze_fr` gives them: stop words are dropped here, too."""
    out, stops = [], set(stops_fr())
    for word in re.findall(r"[^\W_]+", text.lower()):
        plain = "".join(fold(word)) if unaccent_first else word
        if plain not in stops:
            out += fold(stem(plain))
    return out


def simple_tokens(text) -> Column:
    """Runs of letters and digits, lower case, without accents; no stemming."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(unaccent(F.lower(F.coalesce(c, F.lit("")))), F.lit(f"({TOKEN})"), 1)


def analyze_fr(text, unaccent_first: bool = False) -> Column:
    """Stems without stop words. unaccent_first: accents go before the stop list is asked, so accented stop words stay."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lowered = F.lower(c)
    tokens = F.regexp_extract_all(unaccent(lowered) if unaccent_first else lowered, F.lit(f"({TOKEN})"), 1)
    stops = stops_fr()
    kept = F.filter(tokens, lambda t: ~t.isin(stops))
    return stems_unaccented(kept)


#: Characters whose pieces a task makes at once.
AT_ONCE = 1 << 22


def _distinct(texts: list[str]) -> pa.ListArray:
    """The distinct pieces of each text: pieces are numbers by the batch's own letters, told apart by a sort."""
    padded = [f"  {t} " for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    letters, code = np.unique(np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    n = len(letters)
    piece = ((code[:-2] * n + code[1:-1]) * n + code[2:]).astype(np.int64)
    row = np.repeat(np.arange(len(padded)), sizes)
    kinds, kind = np.unique(piece[row[:-2] == row[2:]], return_inverse=True)
    own = np.unique(row[:-2][row[:-2] == row[2:]] * max(1, len(kinds)) + kind)
    names = [chr(letters[k // (n * n)]) + chr(letters[k // n % n]) + chr(letters[k % n]) for k in kinds.tolist()]
    ends = np.searchsorted(own, np.arange(len(padded) + 1) * max(1, len(kinds)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()).take(pa.array(own % max(1, len(kinds)))))


@F.arrow_udf(ArrayType(StringType()))
def _pieces(texts: pa.Array) -> pa.Array:
    parts, some, held = [], [], 0
    for t in texts.to_pylist():
        some.append(t)
        held += len(t)
        if held >= AT_ONCE:
            parts.append(_distinct(some))
            some, held = [], 0
    return pa.concat_arrays([*parts, *([_distinct(some)] if some or not parts else [])]) if texts else pa.array([], pa.list_(pa.string()))


def grams(text) -> Column:
    """The distinct three-letter pieces of a text in lower case, two blanks before it and one after it."""
    c = F.col(text) if isinstance(text, str) else text
    return _pieces(F.lower(F.coalesce(c, F.lit(""))))


def gram_list(text: str, inner: bool = False) -> list[str]:
    """The pieces of a search text; inner: only those that any text around it has, too."""
    whole = text.lower() if inner else f"  {text.lower()} "
    return list(dict.fromkeys(whole[i : i + 3] for i in range(len(whole) - 2)))
