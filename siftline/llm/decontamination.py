"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment.

Texts are lower-cased and runs of white space become one space. An item of m characters with at most k = RATE * m
edits in a text keeps m - q + 1 - k * q of its q-grams there, all within k + 1 neighbouring diagonals (place in the text less place
in the item). So shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half; a band that
reaches the bound becomes a region, and a region is a leak if banded alignment finds the whole item in it with at
most k edits. The filter loses nothing within the budget.

Scale: documents are read once for each block of items and never shuffled. Items come to the driver in blocks of at most
BLOCK_CHARS characters, so what a task holds does not grow with either table.

Defined cases: null or empty items and texts match nothing; an item shorter than q characters, or one whose bound would be below one
q-gram, gets the largest budget with a positive bound (exact search below q); repeated rows and repeated items each have rows of their own; very long texts are a
slice alone; a null doc_id is returned as null; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import inverses
from .common import U64, mapped, mix, powers, table

GRAM, RATE = 10, 0.08
BLOCK_CHARS = 4_000_000
SLICE_CHARS = 1 << 19
_FILTER_BITS = 20


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(length: int, gram: int = GRAM, rate: float = RATE) -> int:
    """Edits allowed for an item; its q-gram bound is one at least."""
    return max(0, min(int(rate * length), (length - gram) // gram))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    n = len(codes)
    if n < gram:
        return np.zeros(0, U64)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(codes.astype(U64) + U64(1)) * powers(n + 1)[:n], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * inverses(n + 1)[: n - gram + 1])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best whole-item match on diagonals low to high of text; None above most edits.

    Semi-global edit distance, one numpy row for each character of the item; starts are carried along.
    """
    diagonals = np.arange(low, high + 1)
    step = np.arange(len(diagonals))
    far = len(item) + len(text) + 1
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    begin = diagonals.copy()
    for i, c in enumerate(item):
        at = diagonals + i
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(len(at), bool)
        same[inside] = text[at[inside]] == c
        new = cost + np.where(inside, ~same, far)
        start = begin.copy()
        skip = np.append(cost[1:] + 1, far)  # a character of the item is missing in the text
        better = skip < new
        new[better], start[better] = skip[better], np.append(begin[1:], 0)[better]
        run = new - step  # characters of the text that the item lacks
        best = np.minimum.accumulate(run)
        src = np.maximum.accumulate(np.where(run == best, step, 0))
        ok = (at + 1 <= len(text)) & (at + 1 >= 0)
        cost, begin = np.where(ok, best + step, far), start[src]
        if cost.min() > most:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), int(diagonals[end] + len(item))


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], gram: int, rate: float):
        self.gram = gram
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.codes = [codes_of(t) for t in self.texts]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([budget(n, gram, rate) for n in self.size], np.int64)
        self.need = np.maximum(1, self.size - gram + 1 - self.edits * gram)
        hashes = [gram_hashes(c, gram) for c in self.codes]
        every = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner, self.place = every[order], owner[order], place[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.short = [j for j in range(len(items)) if 0 < self.size[j] < gram]

    def regions(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) that reach the bound."""
        h = gram_hashes(codes, self.gram)
        at = np.flatnonzero(self.maybe[(h >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, h[at])
        many = np.searchsorted(self.hashes, h[at], "right") - lo
        some = many > 0
        at, lo, many = at[some], lo[some], many[some]
        total = int(many.sum())
        if not total:
            return
        post = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(total)
        item = self.owner[post]
        shift = len(codes)  # items may begin before the text
        diagonal = np.repeat(at, many) - self.place[post] + shift
        band = diagonal // (self.edits[item] + 1)
        wide = np.int64(2 * len(codes) + int(self.size.max()) + 2)
        key = np.concatenate([item * wide + band, item * wide + band - 1])
        key, count = np.unique(key[key >= 0], return_counts=True)
        item, band = key // wide, key % wide
        ok = count >= self.need[item]
        item, band = item[ok], band[ok]
        if len(item):  # neighbouring bands of an item are one region
            new = np.append(True, (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 2))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(item)) - 1
            width = self.edits[item[first]] + 1
            yield from zip(item[first].tolist(), (band[first] * width - shift).tolist(), ((band[last] + 2) * width - 1 - shift).tolist(), strict=True)

    def leaks(self, text: str, codes: np.ndarray, regions: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of verified regions of one text."""
        for j, low, high in regions:
            k = int(self.edits[j])
            pad_lo, pad_hi = max(0, low - k), min(len(codes), high + int(self.size[j]) + k + 1)
            exact = text.find(self.texts[j], pad_lo, pad_hi)
            if exact >= 0:
                yield j, exact, exact + int(self.size[j]), 0
            elif k and (found := align(self.codes[j], codes[pad_lo:pad_hi], low - k - pad_lo, high + k - pad_lo, k)) and found[0] <= k:
                yield j, found[1] + pad_lo, found[2] + pad_lo, found[0]
        for j in self.short:
            if (exact := text.find(self.texts[j])) >= 0:
                yield j, exact, exact + int(self.size[j]), 0


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of at most limit characters (an item above that is a block alone)."""
    held, size = [], 0
    for row in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        if text:
            held.append((row["item_id"], text))
            size += len(text)
    if held:
        yield held


def found_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, rate: float = RATE) -> DataFrame:
    """(key, item_id, start, end, edits): leaks by place in the normalised text, one best match for each region."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in blocks(benchmark):
        part = _scan(own, block, gram, rate)
        out = part if out is None else out.union(part)
    schema = _SCHEMA.format(docs.schema[key].dataType.simpleString())
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


_SCHEMA = "doc_id {}, item_id long, start long, end long, edits long"


def batch_leaks(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of every leak in a batch of texts; slices of texts are filtered at once."""
    gap = np.array([0x110000], np.uint32)  # no character: q-grams over it match nothing
    longest = int(index.size.max())

    def flush(rows: list[tuple[int, str, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int]]:
        starts = np.cumsum([0] + [len(codes) + 1 for _, _, codes in rows[:-1]])
        whole = np.concatenate([x for _, _, codes in rows for x in (codes, gap)])
        by_row: dict[int, list[tuple[int, int, int]]] = {}
        for j, low, high in index.regions(whole):
            r = max(0, int(np.searchsorted(starts, max(0, low), "right")) - 1)
            while r < len(rows) and starts[r] <= high + longest:  # the texts that the region touches
                by_row.setdefault(r, []).append((j, low - int(starts[r]), high - int(starts[r])))
                r += 1
        for r in sorted(by_row) if not index.short else range(len(rows)):
            i, text, codes = rows[r]
            yield from ((i, *leak) for leak in dict.fromkeys(index.leaks(text, codes, by_row.get(r, []))))

    rows, size = [], 0
    for i, value in enumerate(column):
        text = normal(value.as_py())
        if text:
            rows.append((i, text, codes_of(text)))
            size += len(text) + 1
            if size >= SLICE_CHARS:
                yield from flush(rows)
                rows, size = [], 0
    if rows:
        yield from flush(rows)


def _scan(docs: DataFrame, block: list[tuple[int | None, str]], gram: int, rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(block, gram, rate)
        for batch in batches:
            out = list(batch_leaks(index, batch.column(1)))
            if out:
                ids = batch.column(0).take(pa.array([o[0] for o in out]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[o[1]] for o in out], pa.int64()), *(pa.array([o[c] for o in out], pa.int64()) for c in (2, 3, 4))], names=["doc_id", "item_id", "start", "end", "edits"])

    return mapped(docs, run, _SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", gram: int = GRAM, rate: float = RATE) -> DataFrame:
    """The rows of docs in whose text no benchmark item is found; rows are judged one by one, without a join."""
    at = docs.columns.index(text)
    for block in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int | None, str]] = block) -> Iterator[pa.RecordBatch]:
            index = Index(block, gram, rate)
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[leak[0] for leak in batch_leaks(index, batch.column(at))]] = False
                yield batch.filter(pa.array(stay))

        docs = mapped(docs, run, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, edits of every benchmark passage found in a document."""
    return found_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
