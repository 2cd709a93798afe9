"""Substring and similarity search by an index of three-letter pieces.

The index is the one of `operators.index` with pieces as terms (`analyzers.grams`), so it is built, changed, merged and versioned
alike; a document's length there is the number of its different pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analyzers import gram_list
from .index import Index, Needs, asked


def _shared(index: Index, pieces: list[str]) -> DataFrame:
    """Documents with their number of pieces (length) and how many of these ones they have."""
    needs = Needs()
    needs.words.update(pieces)
    return asked(index, needs).groupBy("key").agg(F.count("*").alias("shared"), F.first("length").alias("length"))


def containing(index: Index, rows: DataFrame, q: str, text: str = "text", key: str = "id") -> DataFrame:
    """Rows whose text holds q, in any case, wildcards taken as they are.

    Only rows with all pieces of q are compared with it (the count filter); their keys come from the postings of these pieces alone. A q
    of less than three letters has no piece: then all rows are compared.
    """
    q = q.lower()
    hit = F.contains(F.lower(F.col(text)), F.lit(q))
    pieces = gram_list(q, inner=True)
    if not pieces:
        return rows.where(hit)
    keys = _shared(index, pieces).where(F.col("shared") == len(pieces)).select(F.col("key").alias(key))
    return rows.join(keys, key, "left_semi").where(hit)


def similar(index: Index, q: str, least: float = 0.3) -> DataFrame:
    """key and similarity (pieces in common, of all pieces of either) where it reaches `least`; exact, and no text is read."""
    pieces = gram_list(q)
    score = F.col("shared") / (F.col("length") + F.lit(len(pieces)) - F.col("shared"))
    return _shared(index, pieces).select("key", score.alias("similarity")).where(F.col("similarity") >= least)
