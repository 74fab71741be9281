"""Text expressions that mean the same in Python, the JVM and DuckDB: word and space classes, strip, collapse, keyword boundaries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode letters, digits and underscore; Unicode white space.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space (any Unicode kind) at both ends."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: str | Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def non_blank(c: str | Column) -> Column:
    """The value, untrimmed, or null if it is null or blank."""
    return F.when(strip(c) != "", col(c))


def keyword_regex(keyword: str) -> str:
    """A literal keyword, in any case, with white-space runs between its parts and no word character beside it."""
    parts = [re.sub(r"([^\w\s])", r"\\\1", p) for p in keyword.split()]
    return rf"(?iu)(?<!{WORD})" + rf"{SPACE}+".join(parts) + rf"(?!{WORD})"


def folded(c: str | Column) -> Column:
    """The text with case folded as far as the keyword expressions do, to look for literals in."""
    return F.lower(F.upper(F.translate(col(c), "\u0130", "i")))


def keyword_flag(c: str | Column, keyword: str, fold: str | Column | None = None) -> Column:
    """Does the keyword occur? With the folded text at hand, the expression runs only where the keyword's letters are in it."""
    hit = col(c).rlike(keyword_regex(keyword))
    if fold is not None:
        hit = F.when(col(fold).contains(keyword.split()[0].upper().lower()), hit)
    return F.coalesce(hit, F.lit(False))


def keyword_matches(c: str | Column, keywords: list[str], fold: str | Column | None = None) -> Column:
    """The keywords that occur, each once, in list order."""
    unique = list(dict.fromkeys(keywords))
    flags = F.array(*(F.when(keyword_flag(c, k, fold), F.lit(k)) for k in unique))
    return F.filter(flags, lambda x: x.isNotNull())


def duckdb_keyword(c: str, keyword: str) -> str:
    """The same test in DuckDB, whose regular expressions have no lookaround."""
    word = r"[^\p{L}\p{N}_]"
    body = keyword.replace(" ", r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+")
    return f"regexp_matches({c}, '(?i)(^|{word}){body}($|{word})')"


DUCKDB_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
