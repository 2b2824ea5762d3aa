"""Title, genre and tag string functions (Column -> Column, all JVM-side).

Python's ``re`` treats ``\\s`` and ``\\d`` as Unicode classes and ``str.strip`` strips Unicode
white space; Java regexes need the ``(?U)`` flag for the same behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference's for identical results.
GENRE_SENTINEL = "(no genres listed)"
LEADING_ARTICLES = ("The", "A", "An")
ARTICLE_SUFFIX_PATTERN = r"(?U)^(.*),\s+(The|A|An)\s+\((\d{4})\)\s*$"
YEAR_SUFFIX_PATTERN = r"(?U)\((\d{4})\)\s*$"
YEAR_SUFFIX_STRIP_PATTERN = r"(?U)\s*\(\d{4}\)\s*$"
STRICT_TITLE_PATTERN = r"(?U)^(.*?)\s*\((\d{4})\)\s*$"
NON_ALNUM_PATTERN = r"(?U)[^a-z0-9\s]"
LEADING_ARTICLE_PATTERN = r"(?U)(?i)^(The|A|An)\s+(.+)$"
TAG_SEPARATOR_PATTERN = r"(?U)[-\s]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """``str.strip()``: remove leading/trailing Unicode white space."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def title_article_fix(c) -> Column:
    """FN-1: ``"Matrix, The (1999)"`` -> ``"The Matrix (1999)"``; others unchanged (not trimmed)."""
    t = ustrip(c)
    fixed = F.concat(
        F.regexp_extract(t, ARTICLE_SUFFIX_PATTERN, 2), F.lit(" "),
        ustrip(F.regexp_extract(t, ARTICLE_SUFFIX_PATTERN, 1)), F.lit(" ("),
        F.regexp_extract(t, ARTICLE_SUFFIX_PATTERN, 3), F.lit(")"))
    return F.when(t.rlike(ARTICLE_SUFFIX_PATTERN), fixed).otherwise(_c(c))


def needs_article_fix(c) -> Column:
    """FN-2 predicate: non-null title in ``"X, The (YYYY)"`` form."""
    return F.coalesce(ustrip(c).rlike(ARTICLE_SUFFIX_PATTERN), F.lit(False))


def split_genres(c, sentinel: str = GENRE_SENTINEL) -> Column:
    """FN-3: ``"A|B"`` -> ``[A, B]``; sentinel -> ``[]``; null -> null."""
    g = _c(c)
    return F.when(g == sentinel, F.array().cast("array<string>")).otherwise(F.split(g, r"\|"))


def title_year(c) -> Column:
    """FN-9: trailing ``(YYYY)`` -> int, null when absent."""
    return F.nullif(F.regexp_extract(_c(c), YEAR_SUFFIX_PATTERN, 1), F.lit("")).try_cast("int")


def strip_year_suffix(c) -> Column:
    """FN-10 part: drop a trailing ``(YYYY)`` and strip."""
    return ustrip(F.regexp_replace(_c(c), YEAR_SUFFIX_STRIP_PATTERN, ""))


def title_norm_basic(c) -> Column:
    """FN-10: drop ``(YYYY)`` suffix, strip, lower."""
    return F.lower(strip_year_suffix(c))


def title_norm_plain(c) -> Column:
    """Second-source key: strip, lower (no year to drop)."""
    return F.lower(ustrip(c))


def title_norm_strict(c) -> Column:
    """FN-11: base of ``"<base> (YYYY)"`` lower-cased, non ``[a-z0-9\\s]`` removed, spaces
    collapsed, stripped; null when the title has no ``(YYYY)`` suffix."""
    base = F.regexp_extract(_c(c), STRICT_TITLE_PATTERN, 1)
    return F.when(_c(c).rlike(STRICT_TITLE_PATTERN), norm_strict(base))


def norm_strict(c) -> Column:
    """Strict key of a plain string: lower, drop non ``[a-z0-9\\s]``, collapse spaces, strip."""
    return ustrip(F.regexp_replace(F.regexp_replace(F.lower(_c(c)), NON_ALNUM_PATTERN, ""), r"(?U)\s+", " "))


def title_year_strict(c) -> Column:
    return F.when(_c(c).rlike(STRICT_TITLE_PATTERN),
                  F.regexp_extract(_c(c), STRICT_TITLE_PATTERN, 2).try_cast("int"))


def normalize_spaces(c) -> Column:
    """FN-12: collapse white space runs, strip, lower."""
    return F.lower(ustrip(F.regexp_replace(_c(c), r"(?U)\s+", " ")))


def strip_punct(c) -> Column:
    """FN-13: lower and drop everything but ``[a-z0-9\\s]`` (spaces kept as they are)."""
    return F.regexp_replace(F.lower(_c(c)), NON_ALNUM_PATTERN, "")


def swap_leading_article(c) -> Column:
    """FN-14: ``"The X"`` -> ``"X, The"`` (case-insensitive article)."""
    return F.regexp_replace(_c(c), LEADING_ARTICLE_PATTERN, "$2, $1")


def title_append_year(title, year) -> Column:
    """FN-15: ``strip(title) + " (YYYY)"`` when the year is known, else the title unchanged."""
    return F.when(_c(year).isNotNull(),
                  F.concat(ustrip(title), F.lit(" ("), _c(year).cast("string"), F.lit(")"))
                  ).otherwise(_c(title))


def release_year(c) -> Column:
    """FN-16: lenient ``yyyy-MM-dd`` parse (bad or empty -> null), then the year."""
    return F.year(F.try_to_date(_c(c), "yyyy-MM-dd"))


def normalize_tag(c) -> Column:
    """FN-17: lower; runs of ``-``/white space -> one space; strip."""
    return ustrip(F.regexp_replace(F.lower(_c(c)), TAG_SEPARATOR_PATTERN, " "))


def tag_clean(c) -> Column:
    """FN-18: strip + lower for free-text tags."""
    return F.lower(ustrip(c))


def contains_literal(c, needle: str) -> Column:
    """FN-19: literal (non-regex) substring test."""
    return F.instr(_c(c), needle) > 0
