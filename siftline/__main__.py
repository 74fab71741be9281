"""python -m siftline capture | evaluate | report: the programs on a results folder."""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

from pyspark.sql import SparkSession

from . import programs
from .operators import providers, report
from .sources import config, pages



def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="siftline")
    parser.add_argument("--results-root", default="results")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("capture")
    c.add_argument("--pages", help="captured pages (Parquet); without it, --input is read live")
    c.add_argument("--details", help="captured detail pages (Parquet)")
    c.add_argument("--input", help="search configuration, to read live")
    c.add_argument("--search-base", default="", help="address of searches, for configurations without one")
    c.add_argument("--page-base", default="", help="address that search pages are read from")
    c.add_argument("--detail-base", default="", help="address that detail pages are read from")
    for name, kind in (("limit", int), ("card-limit", int), ("detail-limit", int), ("request-delay", float)):
        c.add_argument(f"--{name}", type=kind)
    c.add_argument("--results-bucket", default="discard", choices=("discard", "waiting_room"))
    c.add_argument("--max-pages", type=int, default=2)
    c.add_argument("--page-size", type=int, default=int(os.environ.get("JOB_SEARCH_PAGE_SIZE", "10")))
    c.add_argument("--sentinel-ad")
    e = commands.add_parser("evaluate")
    which = e.add_mutually_exclusive_group(required=True)
    which.add_argument("--input")
    which.add_argument("--latest", action="store_const", dest="input", const="latest")
    which.add_argument("--waiting-room", action="store_const", dest="input", const="waiting_room")
    e.add_argument("--timestamp")
    e.add_argument("--matcher", default="mock", choices=("mock", "openai"))
    e.add_argument("--model")
    e.add_argument("--job-profile", default="job_profile.txt")
    e.add_argument("--llm-limit", type=int, default=int(os.environ.get("JOB_LLM_EVALUATION_LIMIT", "").strip() or -1))
    r = commands.add_parser("report")
    r.add_argument("--current-input")
    r.add_argument("--hours", type=int, default=12)
    r.add_argument("--dry-run", action="store_true")
    return parser.parse_args(argv)


def captured(spark: SparkSession, a: argparse.Namespace) -> int:
    if bool(a.pages) != bool(a.details) or not (a.pages or a.input):
        raise ValueError("capture needs --pages and --details, or --input")
    cards, details = config.limits(a.card_limit, a.detail_limit, a.limit)
    today = dt.date.today()
    own = config.sentinel(config.sentinel_path(a.results_root, a.sentinel_ad), today.isoformat()) if config.flag(os.environ.get("SENTINEL_MODE")) else None
    delay = a.request_delay if a.request_delay is not None else float(os.environ.get("JOB_SEARCH_REQUEST_DELAY", "0"))
    if a.pages:
        found, known = spark.read.parquet(a.pages), spark.read.parquet(a.details)
    else:
        urls = config.search_urls(config.load(a.input), a.search_base)
        found, known = pages.live(spark, urls, a.page_base, a.max_pages, a.page_size, delay), pages.live_details(a.detail_base, delay)
    done = programs.capture_run(spark, a.results_root, found, known, programs.run_stamp(dt.datetime.now()), today, cards, details, a.results_bucket, a.page_size, a.max_pages, own)
    print(done.text)
    if done.path is None:
        print("No new ads.", file=sys.stderr)
        return 1
    print(f"Wrote {done.path}")
    return 0


def evaluated(spark: SparkSession, a: argparse.Namespace) -> int:
    provider = providers.named(a.matcher, model=a.model)
    profile = config.profile(a.job_profile) if provider else ""
    done = programs.evaluate_run(spark, a.results_root, a.timestamp, a.input, provider, profile, None if a.llm_limit < 0 else a.llm_limit, config.flag(os.environ.get("SENTINEL_MODE")))
    if done.input_path is None:
        print("The waiting room is empty.")
        return 0
    if done.text:
        print(done.text)
    for row in done.log.orderBy("ord").toLocalIterator():
        print(row["line"])
    print(f"Classified input {done.input_path}: {done.metadata}")
    return 0


def reported(spark: SparkSession, a: argparse.Namespace) -> int:
    text = programs.report_run(spark, a.results_root, dt.datetime.now(dt.UTC), a.current_input, a.hours)
    print(text)
    if not a.dry_run:
        token, chat = os.environ.get("TELEGRAM_BOT_TOKEN", ""), os.environ.get("TELEGRAM_CHAT_ID", "")
        report.notify(text, lambda t: report.send_message(token, chat, t), token, chat)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("siftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return {"capture": captured, "evaluate": evaluated, "report": reported}[a.command](spark, a)
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
