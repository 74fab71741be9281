"""Language identification: words first, then progressively shorter character n-grams.

A word that training saw is scored by its log frequency in each language; a word that it did not see is
scored by the mean log frequency of its four-character n-grams (with marks for the word's ends), or of its
three-, two- or one-character ones where no longer one is known. A text gets the language with the highest sum.

Training reads about TRAIN_DOCS documents of each language (keys whose hash is below that share of all hashes; copies of a key once) and keeps what
occurs in them LEAST_TIMES times, so the model's size is bounded by the sample; counting is distributed, and no window or task gathers a language.
Prediction is one pass without a shuffle.

Defined cases: null texts and texts without a letter are 'und' with score 0; a text of letters that the model
knows nothing about gets the most frequent language, with its share as score, and lang_known (the share of words that training saw,
or an n-gram of two or more characters of) tells it apart; a null doc_id is neither
held out nor learned from; documents that share a key are learned from once (the least text); empty texts, repeated rows and ties (the first language in code-point order) have one result a
row; without any labelled document everything is 'und'; texts are read whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table, without

TRAIN_DOCS = 1000
#: A word or n-gram that a language's sample has less often tells nothing; its words are scored by their shorter n-grams.
LEAST_TIMES = 3
#: Words that a task counts before it hands them on.
FLUSH = 20_000
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
#: A text counts as so many words at most when sums are turned into a probability; which language is first does not depend on it.
EVIDENCE = 50
MEMO = 100_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """langs, log shares, and for words (0) and each n-gram length the row of log frequencies of every key."""

    langs: list[str]
    prior: np.ndarray
    rows: dict[int, dict[str, int]]
    logs: dict[int, np.ndarray]


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """Fits a model to the rows whose lang is not null."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: (r["n"], r["keys"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("keys")).collect()}
    if not sizes:
        return Model([], np.zeros(0), {}, {})
    shares = {k: n for k, (n, _) in sizes.items()}
    # Hashes are even over all longs, so a language's keys below this limit are about TRAIN_DOCS; no task sees a language's rows together.
    limit = {k: min(2**63 - 1, TRAIN_DOCS * 2**64 // max(1, keys) - 2**63) for k, (_, keys) in sizes.items()}
    top = F.create_map(*(F.lit(x) for k, v in limit.items() for x in (k, v)))
    sample = rows.where(F.col("h") <= F.element_at(top, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: Counter) -> pa.RecordBatch:
            all_grams: Counter = Counter()
            for (lang, word), n in seen.items():
                all_grams[lang, 0, word] += n
                for order in ORDERS:
                    for g in grams(word, order):
                        all_grams[lang, order, g] += n
            keys = list(all_grams)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(all_grams.values()), pa.int64())], names=["lang", "n", "gram", "times"])

        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.update((lang, w) for w in _WORD.findall(text.as_py().lower()))
                if len(seen) > FLUSH:
                    yield flush(seen)
                    seen.clear()
        if seen:
            yield flush(seen)

    counted = mapped(sample, count, "lang string, n int, gram string, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    kept = counted.where(F.col("times") >= LEAST_TIMES).select("lang", "n", "gram", "times").collect()
    return fitted([tuple(r) for r in kept], shares)


def fitted(counts: list[tuple[str, int, str, int]], shares: dict[str, int]) -> Model:
    """The model of (lang, order, gram, times) counts; order 0 is for words."""
    langs = sorted(shares)
    at = {x: i for i, x in enumerate(langs)}
    rows: dict[int, dict[str, int]] = {}
    for _, n, g, _ in sorted(counts, key=lambda r: (r[1], r[2])):
        rows.setdefault(n, {}).setdefault(g, len(rows[n]))
    logs = {}
    for n, known in rows.items():
        times = np.full((len(known), len(langs)), SMOOTHING)
        for lang, order, g, c in counts:
            if order == n:
                times[known[g], at[lang]] += c
        logs[n] = np.log(times / times.sum(0))
    prior = np.array([shares[x] for x in langs], float)
    return Model(langs, np.log(prior / prior.sum()), rows, logs)


class Scores(dict):
    """Row numbers, in a matrix of scores, of words; unseen words are scored when they first come up. Bounded by MEMO."""

    def __init__(self, model: Model):
        words = model.rows.get(0, {})
        super().__init__(words)
        self.model, self.known = model, len(words)
        self.matrix = np.zeros((self.known + MEMO, len(model.langs)))
        self.seen = np.arange(len(self.matrix)) < self.known  # words with evidence
        if self.known:
            self.matrix[: self.known] = model.logs[0]

    def __missing__(self, word: str) -> int:
        at = len(self)
        self.matrix[at], self.seen[at] = self.backoff(word)
        self[word] = at
        return at

    def backoff(self, word: str) -> tuple[np.ndarray, bool]:
        """Scores of an unseen word; is an n-gram of two or more characters known."""
        for n in ORDERS:
            rows = self.model.rows.get(n, {})
            found = [rows[g] for g in grams(word, n) if g in rows]
            if found:
                return self.model.logs[n][found].mean(0), n > 1
        return np.zeros(len(self.model.langs)), False

    def trim(self, room: int) -> None:
        """Forgets unseen words unless room more fit."""
        if len(self) + room > len(self.matrix):
            self.clear()
            self.update(self.model.rows.get(0, {}))
            if room > MEMO:
                self.matrix = np.concatenate([self.matrix[: self.known], np.zeros((room, self.matrix.shape[1]))])
                self.seen = np.arange(len(self.matrix)) < self.known


def judged(scores: Scores, text: str | None) -> tuple[str, float, float]:
    """Language, score, and the share of words with evidence."""
    model = scores.model
    words = _WORD.findall(text.lower()) if text else []
    if not words or not model.langs:
        return UNKNOWN, 0.0, 0.0
    total, known, step = np.zeros(len(model.langs)), 0, MEMO // 4
    for i in range(0, len(words), step):
        part = words[i : i + step]
        scores.trim(len(part))
        rows = np.fromiter(map(scores.__getitem__, part), np.int64, len(part))
        total += scores.matrix[rows].sum(0)
        known += int(scores.seen[rows].sum())
    z = (total + model.prior) * (min(len(words), EVIDENCE) / len(words))
    z -= z.max()
    p = np.exp(z)
    best = int(p.argmax())
    return model.langs[best], float(p[best] / p.sum()), known / len(words)


def predict(scores: Scores, text: str | None) -> tuple[str, float]:
    return judged(scores, text)[:2]


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_known instead of columns of these names."""
    docs = without(docs, "lang_pred", "lang_score", "lang_known")
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["lang_pred string", "lang_score double", "lang_known double"])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            found = [judged(scores, x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), *(pa.array([f[i] for f in found], pa.float64()) for i in (1, 2))], names=[*names, "lang_pred", "lang_score", "lang_known"])

    return mapped(docs, run, schema)


def held_out(key: str = "doc_id", by: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % by == part, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    done = identified(docs.select("doc_id", "text", held_out().alias("held_out")).select("doc_id", "held_out", "text"), model)
    return done.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
