"""Recency and time: sort keys from relative ages and dates, tolerant timestamps, run stamps and the report gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textx import col

# Minutes in the units of relative ages.
MINUTES = {"minute": 1, "hour": 60, "day": 1440, "week": 10080, "month": 43200}


def posted_key(posted: str | Column, posted_date: str | Column, today: Column) -> dict[str, Column]:
    """posted_class and posted_value: relative ages first (in minutes), then dates (in days), then the rest."""
    text = F.lower(F.trim(F.coalesce(col(posted), F.lit(""))))
    number = F.regexp_extract(text, r"(\d+)\s+(minute|hour|day|week|month)s?", 1)
    unit = F.regexp_extract(text, r"(\d+)\s+(minute|hour|day|week|month)s?", 2)
    units = F.create_map(*(F.lit(x) for pair in MINUTES.items() for x in pair))
    relative = F.when(text.isin("just now", "now"), F.lit(0).cast("long")).when(number != "", number.try_cast("long") * F.try_element_at(units, unit))
    date = F.when(col(posted_date).rlike(r"^\d{4}-\d{2}-\d{2}$"), col(posted_date).try_cast("date"))
    days = F.greatest(F.datediff(today, date), F.lit(0)).cast("long")
    return {"posted_class": F.when(relative.isNotNull(), 0).when(date.isNotNull(), 1).otherwise(2), "posted_value": F.coalesce(relative, days, F.lit(0).cast("long"))}


def latest_first(cards: DataFrame, today: Column, k: int | None = None) -> DataFrame:
    """cards by recency, arrival order on ties; with k, the first k (TakeOrderedAndProject)."""
    keyed = cards.withColumns(posted_key("posted", "posted_date", today))
    ranked = keyed.orderBy("posted_class", "posted_value", "ord")
    return (ranked if k is None else ranked.limit(max(k, 0))).drop("posted_class", "posted_value")


def utc_timestamp(c: str | Column) -> Column:
    """ISO text to timestamp; without an offset it is UTC (the session's zone); null if it cannot be read."""
    return F.try_to_timestamp(F.replace(col(c), F.lit("Z"), F.lit("+00:00")))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def matched_at(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def report_due(ts: Column, zone: str = "Europe/Stockholm", hours: tuple[int, ...] = (7, 19)) -> Column:
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))).isin(*hours)
