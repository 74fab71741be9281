"""Page sources: captured pages by default; a live one is a Python data source with one partition for each search."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls as urls_
from ..functions.html import cards
from ..schema import DETAILS, PAGES


def fetch(url: str, timeout: float = 30) -> tuple[int, str]:
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
            return reply.status, reply.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        if e.code == 429:
            return 429, ""
        raise


def paged(url: str, max_pages: int, page_size: int, delay: float, get: Callable[[str], tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
    """(page, status, html) until a page is short, empty or throttled."""
    for page in range(max_pages):
        if delay > 0:
            time.sleep(delay)
        status, body = get(f"{url}{'&' if '?' in url else '?'}start={page * max(page_size, 1)}")
        yield page, status, body
        if status == 429 or len(cards(body)) < max(page_size, 1):
            return


class SearchPartition(InputPartition):
    def __init__(self, ord_: int, label: str, url: str):
        self.ord, self.label, self.url = ord_, label, url


class LivePages(DataSource):
    """Options: urls and labels (line by line), maxPages, pageSize, requestDelaySeconds, enabled (must be true)."""

    @classmethod
    def name(cls) -> str:
        return "live_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        if str(self.options.get("enabled", "false")).lower() != "true":
            raise ValueError("live pages are off: set enabled to true, or read captured pages")
        return LiveReader(self.options)


class LiveReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        labels = options.get("labels", "").split("\n")
        self.labels = [labels[i] if i < len(labels) and labels[i] else u for i, u in enumerate(self.urls)]
        self.pages, self.size, self.delay = int(options.get("maxPages", 2)), int(options.get("pageSize", 10)), float(options.get("requestDelaySeconds", 0))

    def partitions(self) -> list[InputPartition]:
        return [SearchPartition(i, label, url) for i, (url, label) in enumerate(zip(self.urls, self.labels, strict=True))]

    def read(self, partition: SearchPartition) -> Iterator[tuple]:
        for page, status, body in paged(partition.url, self.pages, self.size, self.delay, fetch):
            yield partition.ord, partition.label, page, status, body


def live(spark: SparkSession, urls: list[str], base: str, max_pages: int, page_size: int, delay: float) -> DataFrame:
    """Pages of searches (schema.PAGES), read live; each is written by the program before it is used twice."""
    if not base:
        raise ValueError("live pages need an address")
    spark.dataSource.register(LivePages)
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", urls_.search_label("u").alias("label"), urls_.page_url(base, "u", F.lit(None).cast("string")).alias("page")).collect()
    by = {r["u"]: r for r in rows}
    options = {"urls": "\n".join(by[u]["page"] for u in urls), "labels": "\n".join(by[u]["label"] for u in urls), "maxPages": str(max_pages), "pageSize": str(page_size), "requestDelaySeconds": str(delay), "enabled": "true"}
    return spark.read.format("live_pages").options(**options).load()


def live_details(base: str, delay: float, get: Callable[[str], tuple[int, str]] = fetch) -> Callable[[DataFrame], DataFrame]:
    """cards -> their detail pages (schema.DETAILS), read live, one request after the other in each task."""
    if not base:
        raise ValueError("live pages need an address")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = []
            for job_id in pdf["job_id"]:
                if delay > 0:
                    time.sleep(delay)
                got.append((job_id, *get(f"{base}/{job_id}")))
            yield pd.DataFrame(got, columns=["job_id", "status", "html"])

    return lambda cards: cards.select("job_id").mapInPandas(read, DETAILS)
