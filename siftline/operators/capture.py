"""Capture: paged scans with an early stop, union of searches, first-wins dedupe with merged labels, memory joins, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, recency, sections
from ..functions.textx import non_blank


def take_while_full(pages: DataFrame, size: str = "results", page_size: int = 10, max_pages: int | None = None, by: str = "search_ord", page: str = "page_no") -> DataFrame:
    """Pages up to and with the first that is short, empty or throttled (status 429), per search."""
    before = Window.partitionBy(by).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    full = (F.col(size) >= max(page_size, 1)) & ~F.col("status").eqNullSafe(F.lit(429)) if "status" in pages.columns else F.col(size) >= max(page_size, 1)
    kept = pages.withColumn("__on", F.min(full).over(before)).where("coalesce(__on, true)").drop("__on")
    return kept if max_pages is None else kept.where(F.col(page) < max_pages)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """pages with cards (array of structs) and results (their number)."""
    parsed = pages.withColumn("cards", F.coalesce(html.cards_udf("html"), F.array().cast(f"array<{html.CARD.simpleString()}>")))
    return parsed.withColumn("results", F.size("cards"))


def cards_of(pages: DataFrame) -> DataFrame:
    """One row for each card of the pages, with its label and ord by search, page and place."""
    rows = pages.where(~F.col("status").eqNullSafe(F.lit(429))).select("search_ord", "label", "page_no", F.posexplode("cards").alias("pos", "card"))
    ord_ = F.col("search_ord").cast("long") * (1 << 40) + F.col("page_no").cast("long") * (1 << 20) + F.col("pos")
    return rows.select(ord_.alias("ord"), "search_ord", "label", "card.*")


def page_audits(pages: DataFrame) -> DataFrame:
    """pages_requested (with the one that failed or was empty), results_seen and throttled of each search."""
    return pages.groupBy("search_ord", F.col("label").alias("search")).agg(F.count("*").alias("pages_requested"), F.sum("results").alias("results_seen"), F.bool_or(F.col("status").eqNullSafe(F.lit(429))).alias("throttled"))


def merged_labels(label: str | Column = "label", ord_: str = "ord") -> Column:
    """Aggregate: the labels in order of arrival, each once."""
    label = F.col(label) if isinstance(label, str) else label
    pairs = F.array_sort(F.collect_set(F.struct(F.col(ord_).alias("o"), label.alias("l"))))
    return F.array_distinct(F.transform(pairs, lambda x: x["l"]))


def first_wins(rows: DataFrame, key: str = "job_id", ord_: str = "ord", label: str | None = "label") -> DataFrame:
    """One row for each key, the earliest; labels of all of them, merged in order, as source_searches."""
    rest = [c for c in rows.columns if c not in (key, label, "search_ord")]
    out = [F.min_by(F.struct(*rest), F.col(ord_)).alias("__first")] + ([merged_labels(label, ord_).alias("source_searches")] if label else [])
    return rows.groupBy(key).agg(*out).select(key, "__first.*", *(["source_searches"] if label else []))


def last_wins(rows: DataFrame, key: str = "job_id", ord_: str = "ord") -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ord_)).alias("__last")).select(key, "__last.*")


def unseen(cards: DataFrame, seen: DataFrame, today: Column, limit: int | None = None) -> DataFrame:
    """cards that memory does not hold, by recency, the first limit of them; seen cards do not use up the limit."""
    fresh = cards.join(seen.select("job_id").distinct(), "job_id", "left_anti")
    return recency.latest_first(fresh, today, limit)


def memory_hits(occurrences: DataFrame, seen: DataFrame, label: str = "label") -> DataFrame:
    """(label, already_in_memory), by occurrence, before any dedupe."""
    known = seen.select(F.col("job_id").alias("__seen")).distinct()
    return occurrences.join(known, F.col("job_id") == F.col("__seen"), "left").groupBy(label).agg(F.count_if(F.col("__seen").isNotNull()).alias("already_in_memory"))


def one_search(pages: DataFrame, seen: DataFrame, today: Column, limit: int, page_size: int = 10, max_pages: int = 2) -> DataFrame:
    """Unseen cards of pages that are all of one search; no page is read for a limit below 1."""
    if limit <= 0:
        pages = pages.limit(0)
    return unseen(first_wins(cards_of(take_while_full(parsed_pages(pages), page_size=page_size, max_pages=max_pages))), seen, today, limit)


def capture(pages: DataFrame, seen: DataFrame, today: Column, limit: int | None, page_size: int = 10, max_pages: int = 2) -> tuple[DataFrame, DataFrame]:
    """(unseen cards, audits) of captured pages over several searches; searches that share a label have audits of their own."""
    if limit is not None and limit <= 0:
        pages = pages.limit(0)
    read = take_while_full(parsed_pages(pages), page_size=page_size, max_pages=max_pages)
    cards = cards_of(read)
    hits = memory_hits(cards, seen, "search_ord")
    audits = page_audits(read).join(hits, "search_ord", "left").select(
        F.col("search_ord").cast("long").alias("ord"), "search", "pages_requested", "results_seen", F.coalesce("already_in_memory", F.lit(0)).alias("already_in_memory"), F.lit(0).cast("long").alias("passed_prefilter"), "throttled",
    )
    return unseen(first_wins(cards), seen, today, limit), audits


def with_details(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Inner join with detail pages, each parsed once; throttled ones drop their card. Values on the page win if their element is there, even if empty."""
    n = int(details.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number: small files that take long to parse are dealt out as well
    parsed = details.where(~F.col("status").eqNullSafe(F.lit(429))).select("job_id", "html").repartition(n, "job_id").select("job_id", html.details_udf("html").alias("__d"))
    # The section is found beside the parser, not behind the join, which may have few tasks.
    page = parsed.select("job_id", *(F.col(f"__d.{c}").alias(f"__{c}") for c in ("title", "company", "posted", "description")), sections.section(F.transform(F.col("__d.segments"), lambda s: s["text"])).alias("__section"))
    rows = cards.join(page, "job_id").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in ("title", "company", "posted")}).withColumn("description", F.col("__description"))
    rows = rows.withColumns({"requirements_text": F.coalesce(non_blank("__section"), F.col("description")), "requirements_extraction_method": F.when(F.col("__section") != "", "pattern").otherwise("full_description")})
    return rows.drop("__title", "__company", "__posted", "__description", "__section")


def with_sentinel(ads: DataFrame, sentinel: DataFrame) -> DataFrame:
    """The sentinel row in front (ord -1)."""
    return sentinel.withColumn("ord", F.lit(-1).cast("long")).unionByName(ads, allowMissingColumns=True)
