"""The three programs over a results lake: capture pages into it, evaluate a run or the waiting room, report.

Each is a few writes, with plans between them; a stage's rows are written before they are used twice or shown to a provider. Only one row for each search, a run's counts and the hits of a
message come to the driver.

Layout: <root>/<bucket>/<run>/<name>.json with ads, <name>_search_audit.json beside a capture, <name>_hits.json, _discard.json, _match_metadata.json and _decisions.json of an evaluation,
<root>/llm_search_stats.csv. A file of rows is a folder of JSON lines; files with an array are read as well.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import recency, screen
from .operators import capture, evaluate, queue, report, stats
from .operators.evaluate import Provider
from .sources import lake

CAPTURE_NAME, WAITING_NAME, DEFERRED_NAME, SENTINEL_ID = "jobs", "waiting_room_jobs", "deferred_jobs", "sentinel-ad"


def run_stamp(now: dt.datetime | None = None) -> str:
    return (now or dt.datetime.now(dt.UTC)).strftime("%Y%m%d_%H%M%S")


def keeper(spark: SparkSession, root: str, run: str) -> Callable[[DataFrame, str], DataFrame]:
    """keep(df, label): df written under the lake's work folder and read again, so that retries see the same rows."""

    def keep(df: DataFrame, label: str) -> DataFrame:
        path = f"{root}/_work/{run}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


class Captured(NamedTuple):
    path: str | None
    text: str


def capture_run(spark: SparkSession, root: str, pages: DataFrame, details: DataFrame | Callable[[DataFrame], DataFrame], run: str, today: dt.date, card_limit: int = 2, detail_limit: int | None = None, bucket: str = "discard", page_size: int = 10, max_pages: int = 2, sentinel: dict[str, str] | None = None, name: str = CAPTURE_NAME) -> Captured:
    """Captured pages (schema.PAGES) and details (schema.DETAILS, or a function of the cards) to screened ads and audits in the lake, and the audit report. Without ads nothing is written (path None)."""
    keep = keeper(spark, root, run)
    day = F.lit(today.isoformat()).cast("date")
    cards, audits = capture.capture(keep(pages, "pages"), lake.seen_ids(spark, root), day, card_limit, page_size, max_pages)
    cards, audits = keep(cards, "cards"), keep(audits, "audits")
    keyed = cards.withColumns(recency.posted_key("posted", "posted_date", day))
    latest = ("posted_class", "posted_value", "ord")
    detailed = queue.numbered(keyed.orderBy(*latest).limit(max(card_limit if detail_limit is None else detail_limit, 0)), *latest, keep=keep).drop(*latest[:2])
    ads = capture.with_details(detailed, keep(details(detailed), "details") if callable(details) else details)
    if sentinel:
        ads = capture.with_sentinel(ads, spark.createDataFrame([sentinel]))
    ads = keep(screen.screened(ads), "ads")
    audits = stats.add_passed(audits, ads)
    text = report.audit_text(report.CAPTURE_TITLE, audits, stats.coverage(audits, ads, last=True), evaluated=False)
    path = None
    if not ads.isEmpty():
        path = lake.write_rows(ads.orderBy("ord").drop("ord"), f"{root}/{bucket}/{run}/{name}.json")
        lake.write_rows(audits.orderBy("ord").drop("ord"), path.replace(".json", "_search_audit.json"))
    lake.drop_runs(spark, f"{root}/_work", "")
    return Captured(path, text)


class Evaluated(NamedTuple):
    input_path: str | None
    metadata: dict
    text: str
    log: DataFrame | None


def waiting_input(spark: SparkSession, root: str, run: str, cap: int | None = None) -> tuple[str | None, bool]:
    """(path of the selected ads of the waiting room, are some deferred): up to cap ads that pass, written under discard with merged audits. Deferred ads go to a new waiting run first."""
    keep = keeper(spark, root, run)
    ads = queue.numbered(lake.waiting_ads(spark, root), F.col("at"), keep=keep)
    selected, deferred = queue.split_by_cap(keep(ads, "waiting"), cap)
    if selected.isEmpty():
        return None, not deferred.isEmpty()
    late = not deferred.isEmpty()
    if late:
        _write_ads(deferred, f"{root}/waiting_room/{run}/{DEFERRED_NAME}.json")
    path = _write_ads(selected, f"{root}/discard/{run}/{WAITING_NAME}.json")
    merged = stats.merge_audits(lake.audits(spark, f"{root}/waiting_room"))
    lake.write_rows(merged.orderBy("search"), path.replace(".json", "_search_audit.json"))
    return path, late


def _write_ads(ads: DataFrame, path: str) -> str:
    """Ads as they came (ad_json), with their merged labels."""
    ads.orderBy("ord").select(F.to_json(F.expr("map_concat(map_filter(from_json(ad_json, 'map<string,variant>'), (k, v) -> k <> 'source_searches'), map('source_searches', to_variant_object(source_searches)))")).alias("value")).write.mode("overwrite").option("compression", "none").text(path)
    return path


def evaluate_run(spark: SparkSession, root: str, run: str | None = None, source: str = "latest", provider: Provider | None = None, profile: str = "", cap: int | None = None, sentinel: bool = False, now: dt.datetime | None = None, batch_size: int | None = evaluate.TRIAGE_BATCH) -> Evaluated:
    """Decides the ads of a file of rows, of the latest run ('latest') or of the waiting room ('waiting_room'), and routes them into the lake.

    Without a provider the mock decides (whatever the screen said) and cap does not count. Stats, and the evaluation report, are for a provider. Consumed waiting runs go last. sentinel: the run
    fails unless the sentinel ad is a hit of the provider; what was written stays.
    """
    waiting = source == "waiting_room"
    if waiting:
        run = run or run_stamp(now)
        before = lake.runs_in(spark, root, "waiting_room")
        path, late = waiting_input(spark, root, run, cap if provider else None)
        if path is None:
            return Evaluated(None, {}, "", None)
    else:
        path = lake.only_input(spark, root, lake.latest_run(lake.discard_runs(spark, root)).first()[0]) if source == "latest" else source
        run = run or lake.run_from_input(path)
    keep = keeper(spark, root, run)
    ads = queue.numbered(lake.ads(lake.files(spark, path), strict=True), "path", "pos", keep=keep)
    decisions = keep(evaluate.two_stage(ads, provider, profile, keep, batch_size) if provider else evaluate.mock_decisions(ads), "decisions")
    matcher = provider.name if provider else "mock"
    at = (now or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    names = {"matcher": matcher, "model": provider.model if provider else None, "matched_at": at, "input_path": path, "timestamp": run}
    stem = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".json")
    done = keep(evaluate.routed(ads, decisions), "routed")
    for bucket, end in (("hits", "hits"), ("discard", "discard")):
        _write_ads(done.where(F.col("bucket") == bucket), f"{root}/{bucket}/{run}/{stem}_{end}.json")
    lake.write_rows(decisions.orderBy("ord"), f"{root}/discard/{run}/{stem}_decisions.json")
    metadata = evaluate.run_metadata(decisions, names)
    lake.write_rows(metadata.coalesce(1), f"{root}/discard/{run}/{stem}_match_metadata.json")
    text = ""
    if provider:
        head = {k: v or "" for k, v in names.items()}
        lake.append_stats(stats.batch_stats(ads, decisions, head), f"{root}/llm_search_stats.csv")
        labels = ads.select("ord", F.explode("source_searches").alias("label")).join(decisions.select("ord", "stage", "hit"), "ord")
        audits = lake.audits(spark, path.replace(".json", "_search_audit.json"))
        both = stats.audit_report(stats.merge_audits(audits), stats.label_counts(labels))
        text = report.audit_text(report.EVALUATION_TITLE, both, stats.coverage(audits, ads), evaluated=True)
    if waiting:
        for old in before:
            lake.drop_runs(spark, f"{root}/waiting_room/{old}", "")
        lake.drop_runs(spark, f"{root}/waiting_room", run if late else "")
    counts = metadata.first().asDict()
    log = evaluate.decision_log(decisions)
    if sentinel:
        evaluate.assert_sentinel(decisions, SENTINEL_ID, "openai").collect()
    return Evaluated(path, counts, text, log)


def report_run(spark: SparkSession, root: str, now: dt.datetime, current_input: str | None = None, hours: int = 12) -> str:
    """The summary message: what was considered lately, what is in memory, and the hits of the run with that input (or the latest)."""
    runs = lake.run_metadata(spark, root)
    at = F.lit(now.astimezone(dt.UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    considered = report.considered_since(runs, at, hours).first()["considered"]
    known = report.distinct_ids(lake.seen_ids(spark, root)).count()
    found = report.current_run(runs, current_input).collect() if current_input else []
    hits = []
    for r in found:
        ads = lake.input_ads(spark, r["input_path"]).withColumn("ord", F.struct("path", "pos"))
        chosen = report.current_hits(lake.decisions(spark, lake.named_path(r["metadata_path"])), ads)
        hits = [x.asDict() for x in chosen.orderBy("ord").collect()]
    return report.message(considered, known, hits, hours)
