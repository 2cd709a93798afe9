"""Text scalars as Column expressions: cleaning, slugs, excerpts, keys. All of it stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT_LEN = 20_000
MIN_TIMELINE, MIN_SEARCH = 40, 60


def _plain(lo: int, hi: int, form: str) -> tuple[str, str]:
    """Letters whose decomposition is one base letter and marks, and those base letters: the table is this rule."""
    pairs = []
    for code in range(lo, hi):
        base = [c for c in unicodedata.normalize(form, chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, UNACCENTED = _plain(0xC0, 0x250, "NFD")
COMPAT, COMPAT_BASE = (a + b for a, b in zip(_plain(0xA1, 0x250, "NFKD"), _plain(0xFF01, 0xFF5F, "NFKD"), strict=True))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unaccent(c) -> Column:
    """Accents off; single marks are dropped too."""
    return F.regexp_replace(F.translate(_col(c), ACCENTED, UNACCENTED), "[̀-ͯ]", "")


def py_strip(c, chars: str = r"\s") -> Column:
    """Both ends, every white space (trim() takes blanks only)."""
    return F.regexp_replace(_col(c), rf"(?U)^[{chars}]+|[{chars}]+$", "")


def valid_text(c, least: int) -> Column:
    """Not null and `least` characters or more between outer blanks."""
    return F.coalesce(F.char_length(F.btrim(_col(c))) >= least, F.lit(False))


def not_blank(c) -> Column:
    return F.coalesce(F.trim(_col(c)) != "", F.lit(False))


def with_default(c, *default) -> Column:
    """The value, or the concatenated default where it is null or empty."""
    c = _col(c)
    return F.when(F.coalesce(c, F.lit("")) == "", F.concat(*default)).otherwise(c)


def cut(c, n: int, mark: str = "...") -> Column:
    c = _col(c)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def _slug(c: Column, ligatures: bool) -> Column:
    out = c
    if ligatures:
        for a, b in (("œ", "oe"), ("Œ", "oe"), ("æ", "ae"), ("Æ", "ae")):
            out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.translate(out, COMPAT, COMPAT_BASE), "[̀-ͯ]", "")
    out = F.regexp_replace(F.lower(out), r"(?U)[^a-z0-9\s-]", " ")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)[-\s]+", "-"), "^-+|-+$", "")


def slugify(c, maxlen: int = 60, empty: str = "contenu", ligatures: bool = True) -> Column:
    """Lower-case words of a-z and 0-9 joined by single dashes; null and "" give "", nothing left gives `empty`.

    The start of a text tells its slug, once more than `maxlen` characters are left of it; only else the whole text is folded.
    """
    c = F.coalesce(_col(c), F.lit(""))
    start = _slug(F.left(c, F.lit(4 * maxlen)), ligatures)
    cut_off = lambda s: F.regexp_replace(F.substring(s, 1, maxlen), "-+$", "")
    whole = _slug(c, ligatures)
    out = F.when(F.char_length(start) > maxlen, cut_off(start)).otherwise(F.when(F.char_length(whole) > maxlen, cut_off(whole)).otherwise(whole))
    return F.when(c == "", F.lit("")).when(out == "", F.lit(empty)).otherwise(out)


def option_code(c, maxlen: int = 64) -> Column:
    """Code of an option by its label: lower-case, other characters become one dash, "na" if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit("na")).otherwise(F.substring(out, 1, maxlen))


def path_slug(c) -> Column:
    """The lenient slug of file imports: blanks to dashes, then nothing but a-z, 0-9, `-`, `_` and `/`."""
    return F.regexp_replace(F.regexp_replace(F.lower(py_strip(c)), r"(?U)\s+", "-"), r"[^a-z0-9\-_/]", "")


#: Form headings that open a text and carry nothing.
HEADINGS = r"(?iu)^(?:\s*titre\s*:\s*|\s*titre\s+de\s+la\s+contribution\s*[:\-–]?\s*|\s*objet\s*:\s*|\s*th[eé]matique\s*:\s*)"


def strip_boilerplate(c) -> Column:
    """One or two such headings at the start go, and the dashes and colons after them."""
    out = _col(c)
    for _ in range(2):
        out = F.regexp_replace(F.regexp_replace(out, HEADINGS, ""), r"^[ \-–—:]+", "")
    return out


def dedupe_segments(c) -> Column:
    """Segments between ellipses: blank and just repeated ones go, the rest is joined by " … "."""
    parts = F.filter(F.transform(F.split(_col(c), "…"), lambda x: py_strip(x)), lambda x: x != "")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1) == x), a).otherwise(F.concat(a, F.array(x))))
    out = py_strip(F.regexp_replace(F.array_join(kept, " … "), r"(?U)\s+", " "))
    return F.regexp_replace(out, r"(?U)\s+([,;:.!?])", "$1")


def postprocess_excerpt(c) -> Column:
    s = F.substring(_col(c), 1, MAX_TEXT_LEN)
    return py_strip(strip_boilerplate(F.when(F.contains(s, F.lit("…")), dedupe_segments(s)).otherwise(s)))


def clean_excerpt(c, max_chars: int = 300) -> Column:
    """Tags off, white space collapsed, headings off; cut after the last sentence if that is past 70 %, else after a word."""
    plain = py_strip(F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "<[^>]+>", ""), r"(?U)\s+", " "))
    text = postprocess_excerpt(plain)
    head = F.substring(text, 1, max_chars)
    turned = F.reverse(head)
    stop = F.least(*(F.when(F.locate(p, turned) > 0, F.locate(p, turned)) for p in ".!?"))  # from the end; null if none
    last_stop = max_chars - stop  # counted from 0
    blank = F.locate(" ", turned)
    return (
        F.when(F.char_length(text) <= max_chars, text)
        .when(last_stop > max_chars * 0.7, F.left(head, last_stop + 1))
        .when((blank > 0) & (blank < max_chars), F.concat(F.left(head, max_chars - blank), F.lit("…")))
        .otherwise(F.concat(head, F.lit("…")))
    )


def clean_snippet(c, maxlen: int) -> tuple[Column, Column]:
    """The start of a text on one line, and whether it was cut."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.translate(F.substring(c, 1, maxlen), "\r\n", "  "), F.char_length(c) > maxlen


def truthy(c) -> Column:
    v = F.lower(py_strip(F.coalesce(_col(c), F.lit(""))))
    return v.isin("1", "true", "vrai", "yes", "oui", "y", "x", "checked") | (v.rlike("^[0-9]+$") & v.rlike("[1-9]"))


def clean_zipcode(c) -> Column:
    digits = F.regexp_replace(_col(c), "[^0-9]", "")
    return F.when(F.char_length(digits) >= 5, F.substring(digits, 1, 5))


def parse_datetime(c, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A timestamp without zone, null where the text isn't one."""
    return F.try_to_timestamp(_col(c), F.lit(form)).cast("timestamp_ntz")


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical form: its columns by name, as JSON."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def cache_key(q, cursor) -> Column:
    """`search:timeline:<cursor>` without a query of two characters, else `search:fts:<query>:<cursor>`; long keys are hashed."""
    folded = F.lower(F.trim(F.coalesce(_col(q), F.lit(""))))
    cur = F.coalesce(_col(cursor), F.lit(""))
    key = F.when(folded == "", F.concat(F.lit("search:timeline:"), cur)).otherwise(
        F.concat(F.lit("search:"), F.when(F.char_length(folded) >= 2, F.lit("fts:")).otherwise(F.lit("timeline:")), folded, F.lit(":"), cur)
    )
    return F.when(F.char_length(key) > 100, F.concat(F.lit("search:sha256:"), F.sha2(key, 256))).otherwise(key)


#: Least popularity and minutes.
TTL_STEPS = [(1000, 60), (100, 45), (20, 30), (5, 15)]


def ttl_minutes(popularity) -> Column:
    c = _col(popularity)
    out = F.lit(5)
    for least, minutes in reversed(TTL_STEPS):
        out = F.when(c >= least, minutes).otherwise(out)
    return F.coalesce(out, F.lit(5))


def meta_title(c, suffix: str, total: int = 65) -> Column:
    room = total - len(suffix)
    c = _col(c)
    return F.concat(F.when(F.char_length(c) > room, F.concat(F.left(c, F.lit(room - 1)), F.lit("…"))).otherwise(c), F.lit(suffix))


def meta_description(c, total: int = 160) -> Column:
    plain = F.trim(F.translate(F.regexp_replace(_col(c), "<[^>]+>", ""), "\r\n", "  "))
    return F.when(F.char_length(plain) > total, F.concat(F.left(plain, F.lit(total - 1)), F.lit("…"))).otherwise(plain)


def iso_date(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss")


def register(spark) -> None:
    """The pandas-backed highlighter for SQL users; the others are Columns."""
    from .highlight import highlight_udf

    spark.udf.register("highlight", highlight_udf)
