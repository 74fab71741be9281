"""Requirement sections: the slice of segments from the first start heading up to the next stop heading, in higher-order functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textx import SPACE, col, strip

# Headings that open a requirements section and headings that close one (matched in any case).
START_HEADINGS = [
    r"^qualifications?$", r"^kvalifikationer$", r"^required qualifications?$", r"^obligatoriska kvalifikationer$", r"^basic qualifications?$",
    r"^grundläggande kvalifikationer$", r"^qualifications\s*/\s*requirements$", r"^kvalifikationer\s*/\s*krav$", r"^qualifications\s*/\s*merits?$",
    r"^kvalifikationer\s*/\s*meriterande$", r"^requirements?$", r"^krav$", r"^the essential requirements", r"^grundläggande krav",
    r"^essential requirements", r"^väsentliga krav", r"^kravprofil$", r"^requirement profile$", r"^candidate profile$", r"^krav för anställningen",
    r"^requirements for the position", r"^we believe you have$", r"^vi tror att du har$", r"^to succeed in (this|the) role you have:?$",
    r"^för att lyckas i rollen har du:?$", r"^who are you\??$", r"^vem är du\??$", r"^who you are$", r"^vem du är$", r"^who are we looking for\??$",
    r"^vem söker vi\??$", r"^who are we looking for\s*/\s*who are you\??$", r"^vem söker vi\s*/\s*vem är du\??$", r"^vi söker dig$",
    r"^we are looking for you$", r"^vi söker dig som:?$", r"^we are looking for someone who:?$", r"^your profile$", r"^din profil$", r"^about you$",
    r"^om dig$", r"^as a person you are$", r"^som person är du$", r"^key experience", r"^nyckelerfarenhet", r"^key experience and competencies:?$",
    r"^erfarenheter och kompetenser:?$", r"^nyckelkompetenser:?$", r"^what you bring", r"^vad du bidrar med", r"^vad du har med dig",
    r"^skills (and|&) experience$", r"^kompetens och erfarenhet$", r"^färdigheter och erfarenhet$", r"^must have$", r"^måste ha$", r"^skallkrav$",
    r"^need to have$", r"^behöver ha$", r"^experience in the following", r"^erfarenhet inom följande", r"^erfarenhet av följande", r"^nice to have$",
    r"^meriterande", r"^det är meriterande", r"^also meritorious:?$", r"^meriterande är också:?$", r"^it is meritorious to have:?$",
    r"^det är meri?terande med:?$", r"^det är mertierande med:?$", r"^below are seen as merits$", r"^nedan ses som meriterande$",
    r"^följande ses som meriterande$", r"^meritorious skills,? qualities and experiences$", r"^meriterande färdigheter,? egenskaper och erfarenheter$",
    r"^önskvärt", r"^plus om", r"^preferred qualifications?$", r"^önskade kvalifikationer$", r"^preferred experience$", r"^önskad erfarenhet$",
]
STOP_HEADINGS = [
    r"^we offer", r"^vi erbjuder", r"^what we offer", r"^vad vi erbjuder", r"^we offer you", r"^vi erbjuder dig", r"^det här erbjuder vi", r"^apply now",
    r"^ansök nu", r"^application", r"^ansökan", r"^skicka din ansökan", r"^välkommen med din ansökan", r"^övrigt$", r"^other information$",
    r"^additional information$", r"^about ", r"^about us$", r"^om oss$", r"^candidate data privacy", r"^personuppgifter", r"^integritet",
    r"^equal opportunity", r"^lika möjligheter", r"^travel, motor vehicle", r"^resor, körkort", r"^for more information", r"^för mer information",
    r"^contact", r"^kontakt", r"^kontakta", r"^ready to act", r"^redo att söka", r"^läs mer", r"^read more",
]
#: A heading has at most so many characters and words; looser limits are for any heading-like line.
MAX_CHARS, MAX_WORDS = 120, 12
LIKE_CHARS, LIKE_WORDS = 90, 10
# Tags that make a block a heading, and the characters that do not count at the ends of a heading.
HEADING_TAGS = ("b", "h1", "h2", "h3", "h4", "h5", "strong")
END_MARKS = " :.\\-–—"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it; Catalyst computes columns within higher-order functions and branches each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bare(c: Column) -> Column:
    """The text without white space, and then without marks, at its ends."""
    return F.regexp_replace(strip(c), f"^[{END_MARKS}]+|[{END_MARKS}]+$", "")


def _guarded(text: Column, chars: int, words: int) -> Column:
    """Is bare text short and not a sentence?"""
    count = F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))
    return (text != "") & (F.char_length(text) <= chars) & (count <= words) & ~text.rlike("[.!]$")


def _joined(patterns: list[str]) -> str:
    """One expression for all; where each is tied to the start as a whole, they are tried there only, not at every character."""
    tied = all(p.startswith("^") and "|" not in re.sub(r"\([^()]*\)", "", p) for p in patterns)
    joined = "|".join(f"(?:{p})" for p in patterns).replace(r"\s", SPACE)
    return f"(?iu)^(?:{joined})" if tied else f"(?iu){joined}"


def matches_any(c: Column, patterns: list[str]) -> Column:
    return bare(c).rlike(_joined(patterns))


def _heads(text: Column, patterns: list[str]) -> Column:
    """Is bare text a heading?"""
    return F.coalesce(_guarded(text, MAX_CHARS, MAX_WORDS) & text.rlike(_joined(patterns)), F.lit(False))


def is_heading(c: Column, patterns: list[str]) -> Column:
    return _let(bare(c), lambda text: _heads(text, patterns))


def is_heading_like(c: Column, tags: Column) -> Column:
    """Short, no sentence, and a heading tag, a colon at the end, upper case, or a capital on every word."""
    text = bare(c)
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    title = text.rlike(r"^[^\p{L}]*\p{Lu}[^\p{Lu}]*(?:(?<!\p{L})\p{Lu}[^\p{Lu}]*)*$") & ~text.rlike(r"(?<!\p{L})\p{Ll}")
    return F.coalesce(_guarded(text, LIKE_CHARS, LIKE_WORDS) & (F.arrays_overlap(tags, F.array(*map(F.lit, HEADING_TAGS))) | strip(c).endswith(":") | upper | title), F.lit(False))


def section(texts: str | Column, starts: list[str] = START_HEADINGS, stops: list[str] = STOP_HEADINGS) -> Column:
    """Lines of the section, joined by line breaks; '' without a start heading. texts: array of segment texts in order."""
    lines = col(texts)
    place = lambda texts, patterns: F.array_position(F.transform(texts, lambda t: _heads(t, patterns)), True).cast("int")

    def kept(bares: Column, first: Column) -> Column:
        start = F.greatest(first, F.lit(1))
        stop = place(F.slice(bares, start + 1, F.greatest(F.size(bares), F.lit(1))), stops)
        return _let(stop, lambda n: F.slice(lines, start, F.when(n > 0, n).otherwise(F.size(lines))))

    found = _let(F.transform(lines, bare), lambda bares: _let(place(bares, starts), lambda first: F.when(first > 0, F.array_join(kept(bares, first), "\n"))))
    return F.coalesce(found, F.lit(""))
