"""Evaluation: mock decisions, the screen in front, batched triage, confirmation of candidates, and routing of the outcome.

Providers are side effects, so each stage's answers are written before the next stage reads them; a retry never asks twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.screen import passes, rejection_reason, word_hit
from ..functions.textx import non_blank

MOCK_REASONS = ("Description contains the word.", "Description does not contain the word.")
TRIAGE_REJECTION = "Rejected by Eval 2: LLM triage."
MIN_TOKENS, BASE_TOKENS, TOKENS_EACH, MAX_TOKENS = 256, 160, 120, 2048
#: Ads of one triage call; a batch of more would not fit a model's context.
TRIAGE_BATCH = 500


class Reply(NamedTuple):
    """A JSON text that the parsers expect, the tokens used (JSON) and the model that answered."""

    text: str
    usage: str | None = None
    model: str | None = None


class Provider(Protocol):
    name: str
    model: str

    def triage(self, ads: list[dict], profile: str) -> Reply: ...

    def confirm(self, ad: dict, profile: str) -> Reply: ...


def token_budget(n: Column) -> Column:
    return F.least(F.lit(MAX_TOKENS), F.greatest(F.lit(MIN_TOKENS), BASE_TOKENS + TOKENS_EACH * F.greatest(n, F.lit(0))))


def profile_key(profile: Column) -> Column:
    return F.concat(F.lit("job-profile:"), F.left(F.sha2(profile, 256), F.lit(16)))


def ad_text() -> Column:
    """'Label: value' lines of the fields that are not blank."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{c.title()}: "), non_blank(c)) for c in ("title", "company", "location", "description")))


def compact_ad(candidate: Column) -> Column:
    """JSON of the fields that triage reads; blank ones are left out."""
    wanted = F.coalesce(non_blank("requirements_text"), non_blank("description"))
    return F.to_json(F.struct(candidate.alias("candidate_id"), *(non_blank(c).alias(c) for c in ("title", "company", "location")), wanted.alias("requirements")))


def candidate_id(job_id: str, place: Column) -> Column:
    """The id, or index- and the place in the batch that is sent."""
    own = F.col(job_id).cast("string")
    return F.coalesce(F.when(own != "", own), F.concat(F.lit("index-"), place.cast("string")))


def mock_decisions(ads: DataFrame, word: str = "engineer") -> DataFrame:
    """One decision for every ad, whatever the screen said."""
    hit = word_hit("description", word)
    return ads.select("ord", "job_id", "title", hit.alias("hit"), F.when(hit, MOCK_REASONS[0]).otherwise(MOCK_REASONS[1]).alias("reason"), F.lit("mock").alias("matcher"), F.lit(None).cast("string").alias("stage"))


def screen_rejections(ads: DataFrame) -> DataFrame:
    rejected = ads.where(~passes("prefilter_pass"))
    return rejected.select("ord", "job_id", "title", F.lit(False).alias("hit"), rejection_reason("prefilter_reason").alias("reason"), F.lit("prefilter").alias("matcher"), F.lit("prefilter").alias("stage"))


def stage_label(stage: str | Column, hit: str | Column) -> Column:
    stage, hit = (F.col(c) if isinstance(c, str) else c for c in (stage, hit))
    return F.when(stage == "prefilter", "Eval 1: Keywords").when(stage == "triage", "Eval 2: LLM triage").when((stage == "confirmation") | hit.eqNullSafe(F.lit(True)), "Eval 3: LLM confirmation").otherwise("unknown")


def _starts(part: pa.RecordBatch) -> np.ndarray:
    """Places where another batch begins."""
    keys = _keys(part)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _keys(part: pa.RecordBatch) -> np.ndarray:
    return part.column("batch").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def whole_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by batch, cut so that no batch is in two parts."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        cut = int(_starts(part)[-1])  # of the last batch more may come
        if held and not cut and _keys(held[-1])[-1] == _keys(part)[0]:
            held.append(part)
            continue
        if done := held + [part.slice(0, cut)] * (cut > 0):
            yield pa.concat_batches(done)
        held = [part.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def two_stage(ads: DataFrame, provider: Provider, profile: str, keep: Callable[[DataFrame, str], DataFrame], batch_size: int | None = TRIAGE_BATCH) -> DataFrame:
    """Decisions for every ad: screen, a triage call for each batch of ads that pass (by ordinal; None: one call for all), one confirmation for each candidate.

    ads: ord (dense, see queue.numbered), job_id, title, the texts and prefilter_pass; confirmations see the whole ad. keep writes a stage's answers and reads them back. With nothing that passes,
    the provider is not asked. One bad triage candidate fails its batch. A candidate id means an ad of its own batch only.
    """
    rejected = screen_rejections(ads)
    batch = F.floor(F.col("ord") / batch_size).cast("long") if batch_size else F.lit(0).cast("long")
    fields = [c for c in ("title", "company", "location", "description") if c in ads.columns]
    sent = ads.where(passes("prefilter_pass")).select(batch.alias("batch"), F.col("ord").cast("long").alias("ord"), *(F.col(c).cast("string").alias(c) for c in ("job_id", "title")), compact_ad(F.lit("")).alias("ad"), F.to_json(F.struct(*fields)).alias("whole"))

    def triage(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_batches(parts):
            cuts = [*_starts(part), part.num_rows]
            jobs, ads, made = part.column("job_id").to_pylist(), part.column("ad").to_pylist(), []
            for first, end in pairwise(cuts):
                ids = [j or f"index-{i}" for i, j in enumerate(jobs[first:end])]
                reply = provider.triage([json.loads(a) | {"candidate_id": c} for a, c in zip(ads[first:end], ids, strict=True)], profile)
                found = jsonx.parse_triage(reply.text, set(ids))
                made += [(c, found.get(c), len(found), reply.usage, reply.model) for c in ids]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "candidate_id", "triage_reason", "triage_candidate_count", "triage_usage", "triage_model"])

    schema = "batch long, ord long, job_id string, title string, ad string, whole string, candidate_id string, triage_reason string, triage_candidate_count int, triage_usage string, triage_model string"
    # Batches are read one after another from sorted rows; a group of its own for each would cost more than its ads. The number of partitions is given, since small rows take long.
    n = int(ads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(n, "batch").sortWithinPartitions("batch", F.col("ord").asc_nulls_last())
    triaged = keep(dealt.mapInArrow(triage, schema), "triage")

    def confirm(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            replies = [provider.confirm(json.loads(a), profile) for a in pdf["whole"]]
            yield pdf[["batch", "candidate_id"]].assign(answer=[r.text for r in replies], usage=[r.usage for r in replies], answer_model=[r.model for r in replies])

    # Of a batch's ads that share a candidate id the last is confirmed, and all of them get its decision.
    asked = triaged.where("triage_reason IS NOT NULL").groupBy("batch", "candidate_id").agg(F.max_by("whole", "ord").alias("whole"))
    answers = asked.mapInPandas(confirm, "batch long, candidate_id string, answer string, usage string, answer_model string")
    confirmed = keep(answers.withColumn("decision", jsonx.strict_match("answer")), "confirmation")
    joined = triaged.join(confirmed, ["batch", "candidate_id"], "left")
    done = joined.select(
        "ord", "job_id", "title", F.coalesce("decision.hit", F.lit(False)).alias("hit"), F.coalesce("decision.reason", F.lit(TRIAGE_REJECTION)).alias("reason"), F.lit(provider.name).alias("matcher"),
        F.when(F.col("decision").isNotNull(), "confirmation").otherwise("triage").alias("stage"), F.coalesce("answer_model", "triage_model", F.lit(provider.model)).alias("model"),
        "candidate_id", "triage_reason", "triage_candidate_count", "usage", "triage_usage", F.col("answer").alias("raw_response"),
    )
    return done.unionByName(rejected, allowMissingColumns=True)


def routed(ads: DataFrame, decisions: DataFrame) -> DataFrame:
    """ads with bucket: hits or discard, by decisions of the same ordinals; a missing or spare decision fails the query."""
    joined = ads.withColumn("__ad", F.lit(True)).join(decisions.select("ord", F.lit(True).alias("__there"), F.col("hit").alias("__hit")), "ord", "full_outer")
    bad = F.when(F.col("__there").isNull() | F.col("__ad").isNull(), F.raise_error(F.lit("decision count must match job count")).cast("string"))
    return joined.withColumn("bucket", F.coalesce(bad, F.when(F.col("__hit"), "hits").otherwise("discard"))).drop("__ad", "__there", "__hit")


def run_metadata(decisions: DataFrame, run: dict[str, str | None]) -> DataFrame:
    """One row: the run's names, how many ads, hits and discards it had. run: matcher, model, matched_at, input_path, timestamp."""
    hits = F.count_if(F.col("hit").eqNullSafe(F.lit(True)))
    counts = decisions.agg(F.count("*").alias("job_count"), hits.alias("hits_count"), (F.count("*") - hits).alias("discards_count"))
    return counts.select(*(F.lit(run.get(c)).cast("string").alias(c) for c in ("matcher", "model", "matched_at", "input_path", "timestamp")), "job_count", "hits_count", "discards_count")


def decision_log(decisions: DataFrame) -> DataFrame:
    """(ord, line): one line for each decision."""
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    shown = {"job_id": F.coalesce("job_id", F.lit("None")), "eval_stage": quoted(stage_label("stage", "hit")), "hit": F.coalesce(F.col("hit").cast("string"), F.lit("none")), "title": quoted(F.col("title")), "reason": quoted(F.col("reason"))}
    return decisions.select("ord", F.concat_ws(" ", F.lit("[decision]"), *(F.concat(F.lit(f"{n}="), c) for n, c in shown.items())).alias("line"))


def title_vowel(title: str | Column) -> Column:
    title = F.col(title) if isinstance(title, str) else title
    return F.coalesce(F.upper(F.left(title, F.lit(1))).isin(*"AEIOU"), F.lit(False))


def assert_sentinel(decisions: DataFrame, sentinel_id: str, matcher: str) -> DataFrame:
    """(ok) true, or the query fails: the sentinel ad must be there, decided by matcher, and a hit."""
    own = decisions.where(F.col("job_id") == sentinel_id).agg(F.count("*").alias("n"), F.bool_and((F.col("matcher") == matcher) & F.col("hit").eqNullSafe(F.lit(True))).alias("good"))
    return own.select(F.when((F.col("n") > 0) & F.col("good"), True).otherwise(F.raise_error(F.lit("the sentinel ad was not a hit of the language model")).cast("boolean")).alias("ok"))
