"""Line-first quality rules: judge every line, drop the failing ones, reject texts that lose too much.

Base counts of a text come from byte arrays (numpy over a slice of texts); the line rules see each line's
words. One pass over the documents, no shuffle.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; a text of any
length is processed whole; repeated rows are judged alike, one result row for each input row; an empty table gives an
empty result; other columns of the input are never read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, mix, shingles, slices, span_hashes, table, words

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_SYMBOL_WORD = re.compile(rb"[#*$%&|<>]")
_TERMINAL = re.compile(rb"[.!?:;][\"')\]]*$")
_SENTENCE = re.compile(rb"[.!?:;][\"')\]]*[\x20\x09-\x0D]")
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of service", "terms of use", "cookie policy", "enable javascript", "subscribe to our newsletter", "sign up for our newsletter", "click here", "lorem ipsum", "skip to content")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode(), re.IGNORECASE | re.ASCII)

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
#: Of a line's words, the percentage that may carry symbols or end in "!!".
SYMBOL_PERCENT, SHOUT_PERCENT = 30, 50
NAV_WORDS = 4


def line_fails(line: bytes, own: list[bytes]) -> str:
    """The first rule that the line, whose words are own (one at least), breaks; else ''."""
    n = len(own)
    if 100 * sum(1 for w in own if _SYMBOL_WORD.search(w)) >= SYMBOL_PERCENT * n:
        return "symbols"
    if n >= 3 and 100 * sum(1 for w in own if w.endswith(b"!!")) >= SHOUT_PERCENT * n:
        return "shouting"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    if not _TERMINAL.search(own[-1]):
        if n <= NAV_WORDS:
            return "navigation"
        if not _SENTENCE.search(line):
            return "punctuation"
    return ""


def clean(text: bytes) -> tuple[bytes, int, int, int, int]:
    """(text of the lines that stay, repeated lines, lines removed, words removed, words)."""
    seen: set[bytes] = set()
    stay, repeated, gone, lost, total = [], 0, 0, 0, 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            stay.append(line)
            continue
        repeated += line in seen
        seen.add(line)
        total += len(own)
        if line_fails(line, own):
            gone += 1
            lost += len(own)
        else:
            stay.append(line)
    return b"\n".join(stay), repeated, gone, lost, total


def _base(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(at) - 1
    starts, ends, doc = words(data, at)
    count = np.bincount(doc, minlength=n)
    summed = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[at[1:]] - c[at[:-1]]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    chars = summed((np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80))
    symbols = summed(_IS_SYMBOL[data])
    full = count[doc] >= 5  # windows of five words only
    h, of = shingles(span_hashes(data, starts, ends)[full], doc[full], n)
    repeat = np.zeros(n, np.int64)
    if len(h):
        _, inverse, times = np.unique(mix(h ^ mix(of.astype(np.uint64))), return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[inverse] >= 2)
        first = np.cumsum(np.where(count >= 5, count, 0)) - np.where(count >= 5, count, 0)
        windows = np.where(count >= 5, count - 4, 0)
        word = first[of[twice]] + twice - (np.cumsum(windows) - windows)[of[twice]]
        covered = np.zeros(int(full.sum()) + 6, np.int64)
        np.add.at(covered, word, 1)
        np.subtract.at(covered, word + 5, 1)
        repeat = np.bincount(doc[full], weights=np.cumsum(covered)[: int(full.sum())] > 0, minlength=n).astype(np.int64)
    return count, chars, symbols, repeat


def clean_lines(df: DataFrame, text: str | Column = "text", *keep: str) -> DataFrame:
    """keep columns, clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, n_words_removed."""
    df = df.select(*(F.col(c) for c in keep), (F.col(text) if isinstance(text, str) else text).alias("__text"))
    out = ["clean_text string", *(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed"))]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]] + out)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(batch.num_columns - 1)
        for lo, hi, data, at in slices(column):
            base = _base(data, at)
            raw = data.tobytes()
            lines = [clean(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            texts = [x[0].decode() if ok else None for x, ok in zip(lines, column.slice(lo, hi - lo).is_valid().to_pylist(), strict=True)]
            counts = [*base[:3], [x[1] for x in lines], base[3], [x[2] for x in lines], [x[3] for x in lines]]
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)] + [pa.array(texts, pa.string())] + [pa.array(c, pa.int64()) for c in counts], names=[*keep, "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed"])

    return map_arrow(df, run, schema)


def judged(df: DataFrame) -> DataFrame:
    """Adds base_failed and kept to the result of clean_lines."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (100 * F.col("n_words_removed") <= MAX_LOST_PERCENT * F.col("n_words"))
    return df.withColumns({"base_failed": failed, "kept": kept})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judged(clean_lines(table(spark, sf_dir, "documents"), "text", "doc_id"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_removed")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l AS (SELECT rid, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l0),
lf AS (SELECT rid, len(ws) AS n,
  row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS dup,
  100 * len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) >= {SYMBOL_PERCENT} * len(ws)
  OR (len(ws) >= 3 AND 100 * len(list_filter(ws, lambda x: x LIKE '%!!')) >= {SHOUT_PERCENT} * len(ws))
  OR regexp_matches(line, '(?i){"|".join(BOILERPLATE)}')
  OR (NOT regexp_matches(ws[-1], '[.!?:;]["'')\]]*$') AND (len(ws) <= {NAV_WORDS} OR NOT regexp_matches(line, '[.!?:;]["'')\]]*[\x20\x09-\x0D]'))) AS fails
  FROM l WHERE len(ws) > 0),
ls AS (SELECT rid, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(n) FILTER (fails), 0)::BIGINT AS n_words_removed FROM lf GROUP BY rid),
wi AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS win FROM w WHERE len(ws) >= 5),
tw AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS k FROM wi),
rw AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM tw WHERE k >= 2) GROUP BY rid),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_removed, 0) AS n_words_removed
  FROM w LEFT JOIN ls USING (rid) LEFT JOIN rw USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * n_words_removed <= {MAX_LOST_PERCENT} * n_words AS kept, n_lines_removed, n_words_removed FROM f
"""
