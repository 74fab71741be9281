"""Toxicity: embeddings of character n-grams, averaged into a linear softmax; both trained jointly in numpy.

A word's vector is the mean of the vectors of its 3- to 6-character n-grams (hashed into BUCKETS rows), so a misspelling that
training never saw shares most of its vector with the word. A passage of PASSAGE words is the mean of
its words; softmax over two classes scores it. A text is as toxic as its worst passage, so that a long
text does not dilute one: training, too, sees a text through its passages (first softly, then the worst alone).

Training is on the driver, on at most TRAIN_TOXIC and TRAIN_CLEAN labelled documents (those of least hash); scoring is one
pass over all documents without a shuffle, with one number for each n-gram.

Defined cases: null and empty texts, or ones without words, get the score of the bias alone; labels that are null or whose doc_id is
null or unknown are ignored, of repeated labels the highest counts, of repeated documents the least text; a null doc_id is not held
out; without labels of both kinds the score is the share of toxic labels, 0 if none; very long texts are read whole; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table, without

TRAIN_TOXIC, TRAIN_CLEAN = 1000, 3000
BUCKETS, DIMENSIONS, LENGTHS = 1 << 16, 8, (3, 4, 5, 6)
PASSAGE = 6
#: Words whose n-grams are summed at once in training.
BLOCK_WORDS = 1 << 16
SOFT_STEPS, HARD_STEPS, RATE, DECAY, EPSILON = 40, 20, 0.3, 1e-4, 3e-4
MEMO = 150_000
_WORD = re.compile(r"[^\W_]+")  # marks at or in a word do not hide it


def features(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for n in LENGTHS for i in range(max(1, len(marked) - n + 1))]


def split(text: str | None) -> list[str]:
    """Lower-cased words; a word that follows itself counts once."""
    words = _WORD.findall(text.lower()) if text else []
    return words[:1] + [b for a, b in zip(words, words[1:], strict=False) if a != b]


def passages(n_words: int) -> np.ndarray:
    """First words of the passages; a rest below half a passage joins the one before."""
    starts = np.arange(0, n_words, PASSAGE)
    return starts[:-1] if len(starts) > 1 and n_words - starts[-1] < PASSAGE // 2 else starts


@dataclass
class Model:
    """score of each n-gram bucket (difference of the two classes) and the bias."""

    grams: np.ndarray
    bias: float


class WordScores(dict):
    """Scores of words, made when they first come up; two generations of at most MEMO words, so that frequent ones stay."""

    def __init__(self, model: Model):
        super().__init__()
        self.grams = model.grams.tolist()
        self.old: dict[str, float] = {}

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        score = self.old.get(word)
        if score is None:
            own = features(word)
            score = sum(map(self.grams.__getitem__, own)) / len(own)
        self[word] = score
        return score


def score(known: WordScores, bias: float, text: str | None) -> float:
    words = split(text)
    z = bias
    if words:
        starts = passages(len(words))
        each = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        z += float((np.add.reduceat(each, starts) / np.diff(np.append(starts, len(words)))).max())
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Full-batch Adam on embeddings, softmax weights and bias together."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), -60.0 if share == 0 else 60.0)
    vocab: dict[str, int] = {}
    token, start, owner, at = [], [], [], 0
    for i, text in enumerate(texts):
        words = split(text)
        if words:
            token.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)))
            own = passages(len(words))
            start.append(own + at)
            owner.append(np.full(len(own), i, np.int32))
            at += len(words)
    if not token:  # labels, but no words
        return Model(np.zeros(BUCKETS), float(np.log(y.mean() / (1 - y.mean()))))
    token, start, owner = np.concatenate(token), np.concatenate(start), np.concatenate(owner)
    size = np.diff(np.append(start, len(token)))
    passage = np.repeat(np.arange(len(start), dtype=np.int32), size)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    docs = owner[first]
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
    flat_, counts = array("i"), array("i")
    for w in vocab:
        own = features(w)
        flat_.extend(own)
        counts.append(len(own))
    flat, n_features, n_words = np.array(flat_, np.int32), np.array(counts, np.int64), len(vocab)
    del flat_, vocab
    word_start = np.cumsum(n_features) - n_features
    blocks = [(lo, min(lo + BLOCK_WORDS, n_words), word_start[lo], word_start[lo] + int(n_features[lo : lo + BLOCK_WORDS].sum())) for lo in range(0, n_words, BLOCK_WORDS)]
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (2, DIMENSIONS)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    target = y[docs]
    weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
    for step in range(1, SOFT_STEPS + HARD_STEPS + 1):
        table_, soft, bias = params
        side = soft[1] - soft[0]
        gram = table_ @ side
        word = np.concatenate([np.add.reduceat(gram[flat[a:b]], word_start[lo:hi] - a) for lo, hi, a, b in blocks]) / n_features
        z = np.add.reduceat(word[token], start) / size
        top = np.maximum.reduceat(z, first)
        sharp = 1 + 7 * step / SOFT_STEPS
        share = np.exp(sharp * (z - top[of])) if step <= SOFT_STEPS else (z == top[of]).astype(float)
        share /= np.add.reduceat(share, first)[of]
        pooled = np.add.reduceat(share * z, first) + bias[1] - bias[0]
        g = (1 / (1 + np.exp(-np.clip(pooled, -60, 60))) - target) * weight
        g_word = np.bincount(token, weights=(g[of] * share / size)[passage], minlength=n_words) / n_features
        g_gram = np.zeros(BUCKETS)
        for lo, hi, a, b in blocks:
            g_gram += np.bincount(flat[a:b], weights=np.repeat(g_word[lo:hi], n_features[lo:hi]), minlength=BUCKETS)
        g_side = g_gram @ table_
        grads = [np.outer(g_gram, side) + DECAY * table_ * (g_gram != 0)[:, None] / BUCKETS, np.stack([-g_side, g_side]) + DECAY * soft, np.array([-g.sum(), g.sum()])]
        for p, gr, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (gr - m)
            v += 0.01 * (gr * gr - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EPSILON)
    table_, soft, bias = params
    seen = np.bincount(flat, minlength=BUCKETS) > 0
    return Model(np.where(seen, table_ @ (soft[1] - soft[0]), 0.0), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = F.xxhash64("doc_id"), F.col("doc_id")
    some = lambda label, n: known.where(F.col("toxic") == label).orderBy(*by).limit(n)  # noqa: E731  a top-k for each class: no task sorts them all
    pick = some(1, TRAIN_TOXIC).union(some(0, TRAIN_CLEAN)).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxic_score instead of a column of that name."""
    docs = without(docs, "toxic_score")
    names = docs.columns
    at = names.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["toxic_score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordScores(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([score(known, model.bias, x.as_py()) for x in batch.column(at)], pa.float64())], names=[*names, "toxic_score"])

    return mapped(docs, run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labels of documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    done = scored(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return done.select("doc_id", "held_out", F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"))
