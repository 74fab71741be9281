"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of character 5-grams.

The model is counted on trusted text (labelled as of quality, not toxic), whole. Highest-order counts are of
occurrences, lower ones of distinct left neighbours; each order has three discounts from its counts of counts. Probabilities
are computed by joins sharded by n-gram: for every distinct 5-gram of the corpus, order by order, its count, its
context's totals and the probability of its suffix meet. A document's perplexity is over its
characters and its end; it is kept if that is at most the QUANTILE of trusted documents of its language, with some
slack for short texts. A 5-gram is two integers, the low 12 bits (gram) and the high 9 bits (high) of its five characters, so
that no characters are merged.

Why characters: joining every word 3-gram of every document with its count would shuffle several times the input; distinct character
5-grams are a small fraction of the text, so that the count joins stay small. What they gather still grows with the corpus.

Scale: one pass makes counts (pre-aggregated for each task), one scores. Where the distinct 5-grams are at most
BROADCAST_GRAMS their log probabilities are broadcast (16 bytes each, under a 64-bit key that is made free of collisions); beyond that, the text is
written in blocks of about BLOCK_BYTES, each block's distinct 5-grams are joined with them by shuffle, and texts and answers meet by block. The set of trusted ids is broadcast below BROADCAST_IDS and joined by shuffle beyond. Quantiles come from
a histogram of log perplexity in steps of 0.001.

Defined cases: null texts and empty ones have null perplexity and are not kept; a null lang is a language of its own; a language
without trusted documents takes the quantile of all its documents; without trusted text every 5-gram is equally likely; repeated rows
are scored alike; ties at the threshold are kept; very long texts are whole; labels without a document are ignored; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, cut, mapped, mix, table, written

ORDER, BITS, HIGH_BITS = 5, 12, 9
QUANTILE = 0.995
#: Short texts vary more: a text of n characters may exceed its language's limit by SLACK / sqrt(n + 1) in log perplexity.
SLACK = 1.5
BROADCAST_GRAMS = 4_000_000
BROADCAST_IDS = 2_000_000
#: Log probabilities are summed as integers of 1 / UNIT: sums are the same in any order and on either way.
UNIT = 1 << 24
SLICE_CHARS = 1 << 19
TASK_GRAMS = 1 << 19
#: Text that shares one table of probabilities where they are not broadcast.
BLOCK_BYTES = 1 << 26


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low bits of 5-grams, text of each, high bits): one for every character and one for the end; the oldest character is highest.

    0 is before the text and 1 its end; the characters U+0000 and U+0001 stand behind the last code point.
    """
    codes, size = [], []
    for t in texts:
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes += [np.zeros(ORDER - 1, np.uint32), np.where(c < 2, c + np.uint32(0x110000), c), np.ones(1, np.uint32)]
        size.append(len(c) + 1)
    c = np.concatenate(codes).astype(np.int64)
    size = np.array(size)
    own = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(own)) + own * (ORDER - 1)

    def joined(part: np.ndarray, bits: int) -> np.ndarray:
        g = np.zeros(len(c) - ORDER + 1, np.int64)
        for j in range(ORDER):
            g = (g << bits) | part[j : len(g) + j]
        return g[at]

    high = c >> BITS
    return joined(c & ((1 << BITS) - 1), BITS), own, joined(high, HIGH_BITS) if high.any() else np.zeros(len(at), np.int64)


def _groups(g: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, which places in it start a new 5-gram)."""
    by = np.lexsort((g, e)) if e.any() else np.argsort(g)
    new = np.ones(len(g), bool)
    new[1:] = (g[by[1:]] != g[by[:-1]]) | (e[by[1:]] != e[by[:-1]])
    return by, new


def _keyed(g: np.ndarray, e: np.ndarray, seed: int) -> np.ndarray:
    """One integer for each 5-gram: itself where it has no high bits, else a negative hash."""
    if not e.any():
        return g
    h = mix(g.view(U64) ^ mix(e.view(U64) + U64(seed))) | U64(1 << 63)
    return np.where(e == 0, g, h.view(np.int64))


def _slices(column: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    rows, texts, size = [], [], 0
    for i, value in enumerate(column):
        text = value.as_py()
        if text:
            rows.append(i)
            texts.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def counted(docs: DataFrame) -> DataFrame:
    """(gram, high, trusted): times that each distinct 5-gram of docs (text, trusted) occurs in trusted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(high), pa.array(times)], names=["gram", "high", "trusted"])

        def summed(g: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            by, new = _groups(g, e)
            first = np.flatnonzero(new)
            return g[by][first], e[by][first], np.add.reduceat(n[by], first)

        grams = high = times = np.zeros(0, np.int64)
        for batch in batches:
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, texts in _slices(batch.column(0)):
                g, own, e = packed(texts)
                new = summed(g, e, trusted[rows][own])
                grams, high, times = summed(*(np.concatenate(x) for x in zip((grams, high, times), new, strict=True)))
                if len(grams) > TASK_GRAMS:
                    yield out()
                    grams = high = times = np.zeros(0, np.int64)
        if len(grams):
            yield out()

    return mapped(docs, run, "gram long, high long, trusted long").groupBy("gram", "high").agg(F.sum("trusted").alias("trusted"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+ from the numbers of n-grams that occur once to four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def probabilities(grams: DataFrame) -> DataFrame:
    """(gram, high, p) for every gram of grams (gram, high, trusted)."""
    low = lambda name, bits, k: F.col(name).bitwiseAND(F.lit((1 << bits * k) - 1))
    suffix = lambda k, g="g", e="e": (low("g", BITS, k).alias(g), low("e", HIGH_BITS, k).alias(e))
    whole = (F.col("gram").alias("g"), F.col("high").alias("e"))
    known = {ORDER: grams.where("trusted > 0").select(*whole, F.col("trusted").alias("c"))}
    asked = {ORDER: grams.select(*whole)}
    for k in range(ORDER - 1, 0, -1):
        known[k] = cut(known[k + 1].select(*suffix(k)).groupBy("g", "e").agg(F.count("*").alias("c")))
        asked[k] = cut(asked[k + 1].select(*suffix(k)).distinct())
    size = asked[1].count() + 1
    p = None
    for k in range(1, ORDER + 1):
        row = known[k].agg(*(F.coalesce(F.sum((F.col("c") == j).cast("long")), F.lit(0)).alias(f"n{j}") for j in range(1, 5))).first()
        d1, d2, d3 = discounts([row[f"n{j}"] for j in range(1, 5)])
        cost = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = {"h": F.shiftright("g", BITS), "f": F.shiftright("e", HIGH_BITS)} if k > 1 else {"h": F.lit(0).cast("long"), "f": F.lit(0).cast("long")}
        totals = known[k].groupBy(*(c.alias(n) for n, c in context.items())).agg(F.sum("c").alias("total"), F.sum(cost).alias("freed"))
        own = asked[k].withColumns(context).join(known[k], ["g", "e"], "left").join(totals, ["h", "f"], "left")
        if p is None:
            own = own.withColumn("lower", F.lit(1.0 / size))
        else:
            own = own.select("*", *suffix(k - 1, "s", "t")).join(p.select(F.col("g").alias("s"), F.col("e").alias("t"), F.col("p").alias("lower")), ["s", "t"])
        value = F.when(F.col("total").isNull(), F.col("lower")).otherwise((F.coalesce(F.col("c") - cost, F.lit(0.0)) + F.col("freed") * F.col("lower")) / F.col("total"))
        p = cut(own.select("g", "e", value.alias("p")))
    return p.select(F.col("g").alias("gram"), F.col("e").alias("high"), "p")


class Known:
    """Log probabilities of 5-grams, found by a key that has no collisions among them; every 5-gram that is asked for must be there."""

    def __init__(self, grams: np.ndarray, high: np.ndarray, logs: np.ndarray):
        by, new = _groups(grams, high)
        first = by[new]
        pairs = grams[first], high[first]
        self.seed = 0
        while len(np.unique(keys := _keyed(*pairs, self.seed))) < len(keys):
            self.seed += 1
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], logs[first][order]

    def sums(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(5-grams, sum of log probabilities) of each text."""
        n, total = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        for rows, texts in _slices(column):
            g, own, e = packed(texts)
            by, new = _groups(g, e)
            first = by[new]
            log = np.empty(len(g), np.int64)
            log[by] = self.logs[np.searchsorted(self.keys, _keyed(g[first], e[first], self.seed))][np.cumsum(new) - 1]
            n[rows] = np.bincount(own)
            total[rows] = np.add.reduceat(log, np.flatnonzero(np.append(True, own[1:] != own[:-1])))
        return n, total


def _schema(docs: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + list(more))


def _scored_by_broadcast(docs: DataFrame, p: DataFrame) -> DataFrame:
    found = p.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Known(*(found.column(c).to_numpy() for c in ("gram", "high", "log_p"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = shared.value.sums(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n), pa.array(total)], names=[*batch.schema.names[1:], "n", "log_p"])

    return mapped(docs, run, _schema(docs.drop("text"), "n long", "log_p long"))


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (text, ...) with block, written: a block is a run of whole texts of one task, of about block_bytes."""
    numbered = docs.withColumn("block", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            if batch.num_rows:
                ends = done + np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy().astype(np.int64))
                starts = np.append(done, ends[:-1])
                done = int(ends[-1])
                block = (batch.column(batch.num_columns - 1).to_numpy() << 32) + starts // block_bytes
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(block)], names=batch.schema.names)

    return written(mapped(numbered, run, numbered.schema), "kn-blocks")


def _asked(docs: DataFrame) -> DataFrame:
    """(block, gram, high): the distinct 5-grams of each block of docs (text, block); one may come twice where tasks share a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), at)), pa.array(grams), pa.array(high)], names=["block", "gram", "high"])

        at, grams, high = -1, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            block = batch.column(1).to_numpy()
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            for lo, hi in zip(first, [*first[1:], len(block)], strict=True):
                if block[lo] != at or len(grams) > TASK_GRAMS:
                    if len(grams):
                        yield out()
                    at, grams, high = int(block[lo]), np.zeros(0, np.int64), np.zeros(0, np.int64)
                for _, texts in _slices(batch.column(0).slice(lo, hi - lo)):
                    g, _, e = packed(texts)
                    by, new = _groups(g, e)
                    g, e = np.concatenate([grams, g[by][new]]), np.concatenate([high, e[by][new]])
                    by, new = _groups(g, e)
                    grams, high = g[by][new], e[by][new]
        if len(grams):
            yield out()

    return mapped(docs, run, "block long, gram long, high long")


def _scored_by_blocks(docs: DataFrame, p: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A block asks for each of its 5-grams once and gets their log probabilities back: a frequent 5-gram costs a row for each block, not for each text."""
    made = blocked(docs, block_bytes)
    answers = _asked(made.select("text", "block")).join(p, ["gram", "high"])
    names = docs.columns[1:]

    def score(texts: pa.Table, answer: pa.Table) -> pa.Table:
        n, total = Known(*(answer.column(c).to_numpy() for c in ("gram", "high", "log_p"))).sums(texts.column("text"))
        return pa.table([*(texts.column(c) for c in names), pa.array(n), pa.array(total)], names=[*names, "n", "log_p"])

    return made.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _schema(docs.drop("text"), "n long", "log_p long"))


def perplexities(docs: DataFrame, ids: DataFrame, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, lang, trusted, n, log_p in units of 1 / UNIT) of every row of docs (doc_id, lang, text). ids: distinct doc_ids of trusted documents."""
    small = ids.count() <= BROADCAST_IDS
    good = ids.select(F.col("doc_id").alias("__good"))
    marked = docs.join(F.broadcast(good) if small else good, F.col("doc_id") == F.col("__good"), "left").select("doc_id", "lang", "text", F.col("__good").isNotNull().alias("trusted"))
    grams = written(counted(marked.select("text", "trusted")), "kn-grams")
    p = probabilities(grams).select("gram", "high", F.round(F.log("p") * UNIT).cast("long").alias("log_p"))
    if grams.count() <= broadcast_grams:
        return _scored_by_broadcast(marked.select("text", "doc_id", "lang", "trusted"), p)
    return _scored_by_blocks(marked.select("text", "doc_id", "lang", "trusted"), p)


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, log_limit): the quantile of log perplexity, upward to 0.001, of a language's trusted documents, or of all where none is."""
    binned = scored.where("log_ppl IS NOT NULL").groupBy("lang", F.ceil(F.col("log_ppl") * 1000).cast("long").alias("bin")).agg(F.count("*").alias("all"), F.sum(F.col("trusted").cast("long")).alias("good"))
    of = Window.partitionBy("lang")
    by = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = binned.withColumns({"n_all": F.sum("all").over(of), "n_good": F.sum("good").over(of), "run_all": F.sum("all").over(by), "run_good": F.sum("good").over(by)})
    enough = F.when(F.col("n_good") > 0, F.col("run_good") >= F.lit(quantile) * F.col("n_good")).otherwise(F.col("run_all") >= F.lit(quantile) * F.col("n_all"))
    return run.where(enough).groupBy("lang").agg((F.min("bin") / 1000).alias("log_limit"))


def classified(docs: DataFrame, ids: DataFrame, quantile: float = QUANTILE, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept of every row of docs (doc_id, lang, text)."""
    log_ppl = F.when(F.col("n") > 0, -F.col("log_p") / F.lit(float(UNIT)) / F.col("n"))
    scored = written(perplexities(docs, ids, broadcast_grams).withColumn("log_ppl", log_ppl), "kn-scores")
    limits = thresholds(scored, quantile).withColumnRenamed("lang", "__lang")
    joined = scored.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return joined.select("doc_id", "lang", F.greatest(F.col("n") - 1, F.lit(0)).alias("n_chars"), F.exp("log_ppl").alias("perplexity"), F.exp("log_limit").alias("threshold"), F.coalesce(F.col("log_ppl") <= F.col("log_limit") + SLACK / F.sqrt("n"), F.lit(False)).alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that every label of theirs calls of quality and none toxic."""
    good: Column = F.min((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(good.alias("good")).where("good").select("doc_id")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classified(docs, trusted_ids(table(spark, sf_dir, "labels")))
