"""Reporting: rolling counts, distinct ids, the current run and its hits, message texts, ASCII tables, notifiers."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recency import utc_timestamp

LIMIT, SUFFIX = 4096, "\n\n[truncated]"


def considered_since(runs: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """(considered): job counts of the runs at or after now - hours; unreadable times and counts are skipped."""
    at = utc_timestamp("matched_at")
    return runs.where(at >= now - F.expr(f"INTERVAL {hours} HOURS")).agg(F.coalesce(F.sum(F.col("job_count").try_cast("long")), F.lit(0)).alias("considered"))


def distinct_ids(*tables: DataFrame, key: str = "job_id") -> DataFrame:
    """Ids of all tables, each once."""
    out = tables[0].select(F.col(key).cast("string").alias("id"))
    for t in tables[1:]:
        out = out.union(t.select(F.col(key).cast("string")))
    return out.where("id <> ''").distinct()


def current_run(runs: DataFrame, input_path: str) -> DataFrame:
    """The first run of that input, or else the one with the greatest matched_at (the first on ties)."""
    ours = F.col("input_path").eqNullSafe(F.lit(input_path))
    return runs.orderBy(ours.desc(), F.when(~ours, F.col("matched_at")).desc_nulls_last(), "ord").limit(1)


def current_hits(decisions: DataFrame, ads: DataFrame) -> DataFrame:
    """Hit decisions with the last ad of their id: title, url and reason with their fallbacks."""
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    one = ads.where("job_id <> ''").groupBy("job_id").agg(F.max_by(F.struct("title", "url"), "ord").alias("ad"))
    rows = decisions.where("hit").join(one, "job_id", "left")
    return rows.select("ord", F.coalesce("job_id", F.lit("None")).alias("job_id"), F.coalesce(full("title"), full("ad.title"), F.lit("Untitled job")).alias("title"), F.coalesce("ad.url", F.lit("")).alias("url"), F.coalesce("reason", F.lit("")).alias("reason"))


def truncated(message: str | Column, limit: int = LIMIT) -> Column:
    message = F.col(message) if isinstance(message, str) else message
    return F.when(F.char_length(message) > limit, F.concat(F.left(message, F.lit(limit - len(SUFFIX))), F.lit(SUFFIX))).otherwise(message)


def hit_block(n: Column, title: str, url: str, reason: str) -> Column:
    return F.concat(F.lit("\n"), n.cast("string"), F.lit(". "), F.col(title), F.lit("\n"), F.coalesce(F.when(F.col(url) != "", F.col(url)), F.lit("No URL in scraped ad.")), F.lit("\nReason: "), F.col(reason))


def message(considered: int, in_memory: int, hits: list[dict[str, str]], hours: int = 12) -> str:
    """The summary of one run; hits are those of one run, a bounded list."""
    lines = ["Job search summary", f"Considered in last {hours} hours: {considered}", f"Ads in memory: {in_memory}", f"New matches in this run: {len(hits)}"]
    for n, hit in enumerate(hits, 1):
        lines += ["", f"{n}. {hit['title']}", hit["url"] or "No URL in scraped ad.", f"Reason: {hit['reason']}"]
    text = "\n".join(lines)
    return text if len(text) <= LIMIT else text[: LIMIT - len(SUFFIX)] + SUFFIX


def ascii_table(headers: list[str], rows: list[list[object]]) -> str:
    """A grid as wide as its longest values."""
    grid = [[str(x) for x in r] for r in (headers, *rows)]
    width = [max(map(len, c)) for c in zip(*grid, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) + " |"
    return "\n".join([rule, line(grid[0]), rule, *map(line, grid[1:]), rule])


# The columns of both audit reports, and their titles.
AUDIT_HEADERS = ("Search", "Already in memory", "Eval 1: Keywords", "Eval 2: LLM triage", "Eval 3: LLM confirmation", "Throttled")
CAPTURE_TITLE, EVALUATION_TITLE, COVERAGE_TITLE = "Search audit", "Search evaluation audit", "Geo coverage"


def audit_text(title: str, audits: DataFrame, coverage: DataFrame, evaluated: bool) -> str:
    """A report of audits (one row for each search, a bounded list) in a grid, with the coverage section if it has rows. evaluated: with the counts of stats.audit_report, by label."""
    counts = ("confirmed", "hits") if evaluated else ()
    rows = audits.orderBy("search" if evaluated else "ord").collect()
    grid = [[r["search"], r["already_in_memory"], r["passed_prefilter"], *([r[c] for c in counts] or ("", "")), "yes" if r["throttled"] else "no"] for r in rows]
    lines = [title, ascii_table(list(AUDIT_HEADERS), grid)]
    metrics = coverage.orderBy("metric_ord").collect()
    if metrics:
        width = max(len(m["metric"]) for m in metrics)
        lines += ["", COVERAGE_TITLE, *(f"{m['metric'].ljust(width)}  {m['value']}" for m in metrics)]
    return "\n".join(lines)


def send_message(token: str, chat: str, text: str, base: str = "https://api.telegram.org") -> None:
    """Posts the text to a chat; a refusal is a ValueError."""
    body = json.dumps({"chat_id": chat, "text": text, "disable_web_page_preview": True}).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"{base}/bot{token}/sendMessage", body, {"Content-Type": "application/json"}), timeout=30) as reply:  # noqa: S310
            reply.read()
    except urllib.error.URLError as e:
        raise ValueError(f"the message was not sent: {e}") from e


def notify(text: str, send: Callable[[str], None] | None = None, token: str = "", chat: str = "") -> None:
    """Prints, or sends if a sender is given; a sender needs credentials."""
    if send is None:
        print(text)
        return
    if not token or not chat:
        raise ValueError("notifier credentials are missing")
    send(text)
