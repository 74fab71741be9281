"""The waiting room: capped selection in order, deferral, and hand-off that cannot lose rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.screen import passes


def split_by_cap(ads: DataFrame, cap: int | None, verdict: str | Column = "prefilter_pass", ord_: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(selected, deferred): the first cap rows that pass, in order, and all rejected rows are selected; no cap selects all.

    The cap-th ordinal is found by a top-k over the passing rows, so no window gathers the queue in one task.
    """
    ok = passes(verdict)
    if cap is None:
        return ads, ads.limit(0)
    if cap <= 0:
        return ads.where(~ok), ads.where(ok)
    last = ads.where(ok).select(ord_).orderBy(ord_).limit(cap).agg(F.max(ord_).alias("__last"), F.count("*").alias("__n"))
    marked = ads.crossJoin(F.broadcast(last))
    late = ok & (F.col("__n") == cap) & (F.col(ord_) > F.col("__last"))
    return marked.where(~late).drop("__last", "__n"), marked.where(late).drop("__last", "__n")


def numbered(rows: DataFrame, *by: str | Column, keep: Callable[[DataFrame, str], DataFrame], name: str = "ord") -> DataFrame:
    """rows with name: 0, 1, 2, ... in the order of by, which must be total.

    Rows are sorted by range; a row's number is its place in its range and the sizes of the ranges before, of which the driver adds up one number each. keep writes
    the sorted rows and reads them back, so that they are dealt out once.
    """
    place = {"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    dealt = keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(place), "numbered")
    sizes = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    start, at = [], 0
    for part in sorted(sizes):
        start += [F.lit(part), F.lit(at)]
        at += sizes[part]
    first = F.element_at(F.create_map(*start), F.col("__part")) if start else F.lit(0)
    return dealt.withColumn(name, (first + F.col("__row")).cast("long")).drop("__part", "__row")


def running_rank(ads: DataFrame, verdict: str | Column = "prefilter_pass", ord_: str = "ord", *, by: str) -> DataFrame:
    """ads with passing_rank: how many rows of the same by pass up to and with this one."""
    w = Window.partitionBy(by).orderBy(ord_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ads.withColumn("passing_rank", F.sum(passes(verdict).cast("long")).over(w))
