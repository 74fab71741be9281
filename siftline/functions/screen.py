"""The keyword screen: explainable accept / reject verdicts as Catalyst expressions, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textx import col, folded, keyword_flag, keyword_matches, non_blank

# The keyword lists and categories that verdicts and reasons depend on.
POSITIVE = [
    "developer", "software", "engineer", "backend", "frontend", "automation", "integration", "python", "systems", "system",
    "AI", "data", "laboratory", "LIMS", "biotechnology", "chemical", "research", "validation", "QA", "platform", "tools",
    "life science", "project assistant", "postdoc", "scientist", "mechanical engineer", "product development", "utvecklare",
    "mjukvara", "ingenjör", "mekanikingenjör", "system", "automatisering", "integration", "laboratorie", "forskare", "forskning",
    "validering", "kvalitet", "plattform", "verktyg", "projektassistent", "biologi", "postdoktor", "onkologi", "krisberedskap",
    "civilt försvar", "utveckling",
]
NEGATIVE = ["sjuksköterska", "lärare", "restaurang", "säljare", "butik", "kundcenter", "elevassistent", "köksmästare", "farmaceut", "psykolog"]
CATEGORIES = {
    "sjuksköterska": "healthcare", "farmaceut": "pharmacy", "psykolog": "healthcare", "lärare": "teaching", "elevassistent": "school support",
    "restaurang": "restaurant", "köksmästare": "restaurant", "säljare": "sales", "butik": "retail", "kundcenter": "customer service",
}
PERMISSIVE = "No obvious rejection keyword matched; permissive borderline pass."
DEFAULT_REJECTION = "Rejected by Eval 1: Keywords."
FIELDS = ("title", "company", "location", "description")


def passes(verdict: str | Column) -> Column:
    """Anything but false passes: null and missing do."""
    return ~col(verdict).eqNullSafe(F.lit(False))


def word_hit(c: str | Column, word: str = "engineer") -> Column:
    return keyword_flag(c, word)


def label_text(labels: str | Column) -> Column:
    return F.coalesce(F.array_join(col(labels), " "), F.lit(""))


def with_verdict(ads: DataFrame, fields: dict[str, Column], positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, categories: dict[str, str] = CATEGORIES) -> DataFrame:
    """ads with prefilter_pass, prefilter_reason, prefilter_positive_matches and prefilter_negative_matches of fields in their order.

    A positive keyword anywhere wins over negatives; the reason names the first field and the first keyword of the list in it. Each field is folded once and each
    keyword is looked for once: the steps are projections of their own, which the optimiser does not merge as their values are used several times.
    """
    names = list(fields)
    rows = ads.withColumns({f"__text_{n}": c for n, c in fields.items()})
    rows = rows.withColumns({f"__fold_{n}": folded(f"__text_{n}") for n in names})
    rows = rows.withColumns({f"__{kind}_{n}": keyword_matches(f"__text_{n}", words, f"__fold_{n}") for n in names for kind, words in (("good", positive), ("bad", negative))})
    rows = rows.withColumns({f"__{kind}": F.array_distinct(F.flatten(F.array(*(F.col(f"__{kind}_{n}") for n in names)))) for kind in ("good", "bad")})
    first = F.coalesce(*(F.when(F.size(f"__good_{n}") > 0, F.concat(F.lit(f"Matched {n} keyword: "), F.try_element_at(f"__good_{n}", F.lit(1)))) for n in names))
    first_bad = F.try_element_at("__bad", F.lit(1))
    kinds = F.create_map(*(F.lit(x) for pair in categories.items() for x in pair)) if categories else F.create_map()
    rejected = F.concat(F.lit("Rejected obvious "), F.coalesce(F.try_element_at(kinds, first_bad), F.lit("non-match")), F.lit(" role: "), first_bad)
    done = {
        "prefilter_pass": (F.size("__good") > 0) | (F.size("__bad") == 0),
        "prefilter_reason": F.coalesce(first, rejected, F.lit(PERMISSIVE)),
        "prefilter_positive_matches": F.col("__good"),
        "prefilter_negative_matches": F.col("__bad"),
    }
    kept = [c for c in ads.columns if c not in done]
    return rows.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(n) for n, c in done.items()))


def screened(ads: DataFrame) -> DataFrame:
    """ads with the verdict columns; labels count as text."""
    fields = {name: F.coalesce(F.col(name), F.lit("")) for name in FIELDS}
    return with_verdict(ads, fields | {"source_searches": label_text("source_searches")})


def rejection_reason(reason: str | Column) -> Column:
    return F.coalesce(non_blank(reason), F.lit(DEFAULT_REJECTION))

