"""Aggregates over labels, audits and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.screen import passes
from ..functions.textx import col, strip
from ..functions.urls import is_geo_only

COUNTS = ("pages_requested", "results_seen", "already_in_memory", "passed_prefilter")


def clean_labels(labels: str | Column) -> Column:
    """Trimmed labels that are not blank, repeats kept; ['unknown'] if none."""
    kept = F.filter(F.transform(F.coalesce(col(labels), F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("unknown")))


def merge_audits(audits: DataFrame) -> DataFrame:
    """One row for each label: sums, and whether any was throttled."""
    label = F.coalesce(F.when(F.col("search") != "", F.col("search")), F.lit("unknown"))
    return audits.groupBy(label.alias("search")).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in COUNTS), F.coalesce(F.bool_or("throttled"), F.lit(False)).alias("throttled"))


def add_passed(audits: DataFrame, ads: DataFrame) -> DataFrame:
    """audits with passed_prefilter counted from ads; where a label is given twice, only its last audit counts."""
    passed = ads.where(passes("prefilter_pass")).select(F.explode("source_searches").alias("search")).groupBy("search").agg(F.count("*").alias("__passed"))
    last = audits.groupBy("search").agg(F.max("ord").alias("__last"))
    rows = audits.join(last, "search").join(passed, "search", "left")
    return rows.withColumn("passed_prefilter", F.col("passed_prefilter") + F.when(F.col("ord") == F.col("__last"), F.coalesce("__passed", F.lit(0))).otherwise(0)).drop("__last", "__passed")


def label_stats(rows: DataFrame, label: str = "label", stage: str = "stage", hit: str = "hit") -> DataFrame:
    """The eight counters of each label. rows: one for each ad and label, with its decision."""
    is_stage = lambda s: F.col(stage).eqNullSafe(F.lit(s))
    yes = F.col(hit).eqNullSafe(F.lit(True))
    other = ~is_stage("prefilter")
    return rows.groupBy(label).agg(
        F.count("*").alias("new_ads"),
        F.count_if(other).alias("passed_prefilter"),
        F.count_if(is_stage("prefilter")).alias("rejected_by_prefilter"),
        F.count_if(other).alias("triaged_ads"),
        F.count_if(is_stage("confirmation")).alias("confirmation_candidates"),
        F.count_if(other & ~is_stage("triage") & yes).alias("matches"),
        F.count_if(is_stage("triage")).alias("rejected_by_triage"),
        F.count_if(is_stage("confirmation") & ~yes).alias("discarded_after_confirmation"),
    )


def batch_stats(ads: DataFrame, decisions: DataFrame, run: dict[str, str]) -> DataFrame:
    """Rows for the stats sink: label_stats of a batch with its totals, which count every ad once."""
    joined = ads.select("ord", clean_labels("source_searches").alias("labels")).join(decisions.select("ord", "stage", "hit"), "ord")
    totals = joined.agg(F.count("*").alias("total_batch_ads"), F.count_if(F.col("hit").eqNullSafe(F.lit(True))).alias("total_batch_matches"))
    stats = label_stats(joined.select(F.explode("labels").alias("label"), "stage", "hit"))
    head = [F.lit(run.get(c, "")).alias(c) for c in ("matched_at", "timestamp", "matcher", "model")]
    return stats.crossJoin(F.broadcast(totals)).select(*head, F.col("label").alias("search_term"), *[c for c in stats.columns if c != "label"], "total_batch_ads", "total_batch_matches")


def label_counts(rows: DataFrame, label: str = "label", stage: str = "stage", hit: str = "hit") -> DataFrame:
    """passed, rejected, confirmed (sent on by triage) and hits of each label; a label of rejected ads only has a zero row."""
    rejected, confirmed = (F.col(stage).eqNullSafe(F.lit(s)) for s in ("prefilter", "confirmation"))
    return rows.groupBy(label).agg(F.count_if(~rejected).alias("passed"), F.count_if(rejected).alias("rejected"), F.count_if(confirmed).alias("confirmed"), F.count_if(F.col(hit).eqNullSafe(F.lit(True))).alias("hits"))


def audit_report(audits: DataFrame, counts: DataFrame) -> DataFrame:
    """Full outer join of merged audits and label counts; Eval-1 counts come from decisions where there are any."""
    joined = audits.join(counts.withColumnRenamed("label", "search"), "search", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("search", *(zero(c) for c in COUNTS[:3]), F.coalesce("passed", "passed_prefilter", F.lit(0)).alias("passed_prefilter"), zero("rejected"), zero("confirmed"), zero("hits"), F.coalesce("throttled", F.lit(False)).alias("throttled"))


# The rows of the coverage section, in order.
COVERAGE = (("Geo-visible jobs", "visible"), ("Seen by keyword searches", "both"), ("Geo-only only", "geo_only"), ("Already in memory", "in_memory"), ("New to memory", "distinct_ads"), ("Passed Eval 1: Keywords", "passed"), ("Rejected by Eval 1: Keywords", "rejected"))


def coverage(audits: DataFrame, ads: DataFrame, last: bool = False) -> DataFrame:
    """(metric_ord, metric, value): coverage of location-only searches; no rows without one. ads: ord, job_id, source_searches, prefilter_pass.

    The first of an id counts, with trimmed labels; with last (right after a capture) the last, with its labels as they are.
    """
    pick = F.max_by if last else F.min_by
    labels = F.coalesce("source_searches", F.array().cast("array<string>")) if last else clean_labels("source_searches")
    key = F.coalesce(F.when(F.col("job_id") != "", F.col("job_id")), F.to_json(F.struct(*[c for c in ads.columns if c != "ord"])))
    one = ads.groupBy(key.alias("k")).agg(pick(F.struct(labels.alias("labels"), passes("prefilter_pass").alias("ok")), F.col("ord")).alias("ad"))
    geo = F.exists("ad.labels", is_geo_only)
    word = F.exists("ad.labels", lambda x: ~is_geo_only(x) & (x != "unknown"))
    seen = audits.where(is_geo_only("search")).agg(F.sum("results_seen").alias("visible"), F.sum("already_in_memory").alias("in_memory"), F.count("*").alias("n"))
    totals = one.agg(F.count_if(geo & word).alias("both"), F.count_if(geo & ~word).alias("geo_only"), F.count("*").alias("distinct_ads"), F.count_if("ad.ok").alias("passed"), F.count_if(~F.col("ad.ok")).alias("rejected"))
    wide = F.broadcast(seen).crossJoin(totals).where("n > 0")
    rows = F.array(*(F.struct(F.lit(i).alias("metric_ord"), F.lit(name).alias("metric"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for i, (name, c) in enumerate(COVERAGE)))
    return wide.select(F.inline(rows))
