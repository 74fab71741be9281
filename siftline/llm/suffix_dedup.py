"""Exact substring deduplication: bytes covered by a 200-byte string that also starts elsewhere.

Method: suffix arrays by Larsson-Sadakane refinement in numpy, common prefixes by Kasai's recurrence, one
suffix array for each shard, and binary search across shards where one shard is not enough.

What makes it linear in the corpus is how text is dealt to shards. Every 200-byte window owns one anchor
(anchors.py), and equal windows own equal anchors; so runs of windows with one anchor meet by the
anchor's hash, and only the bytes of runs that share an anchor but are not equal as a whole go to a
shard. Runs that are equal as a whole are settled by their hash; equal texts by theirs. An anchor with
very many different runs is split over several shards, each with its own suffix array; their sorted window
fingerprints, cut into ranges, are merged by binary search.

Anchors, runs and equal texts meet by 64-bit hashes that are joined in pairs (anchor and run); windows in a shard are
compared byte by byte, windows across split shards by 64-bit fingerprints under one anchor.

Defined cases: a null text counts as empty and stays null in the cleaned text; texts below 200 bytes lose
nothing; copies of a text of 200 bytes or more lose all of it, repeated rows are copies; null or repeated doc_ids
do no harm, as texts are told apart by content; an empty table gives an empty result; other columns are
carried along by dedup_spans and may have any name without a leading double underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import U64, binaries, cut, mapped, mix, slices, table

LENGTH = 200
GRAM = 40
CHUNK_BYTES = 1 << 20
#: Different runs of one anchor in one shard.
SHARD_RUNS = 4096
_RUN = LENGTH - GRAM  # a run has at most _RUN + 1 windows


def suffix_order(data: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group starts): positions p whose length-byte string, which ends by end[p], may repeat, in its order.

    Larsson-Sadakane: ranks by the first eight bytes, then by twice as many in each round; a position that is
    alone with its prefix is sorted and is not looked at again.
    """
    n = len(data)
    position = np.arange(n)
    active = position[position + 8 <= end]
    if not len(active):
        return active, np.zeros(0, bool)
    packed = np.zeros(len(active), U64)
    for j in range(8):
        packed = (packed << U64(8)) | data[active + j].astype(U64)
    rank = np.zeros(n, np.int64)
    active, first = _regroup(active, packed, np.zeros(len(active), np.int64), rank)
    depth = 8
    while True:
        step = depth if 2 * depth <= length else length - depth
        reach = min(2 * depth, length)
        active = active[active + reach <= end[active]]
        if not len(active):
            return active, np.zeros(0, bool)
        base = rank[active]
        key = (base.astype(U64) << U64(32)) | rank[active + step].astype(U64)
        if reach == length:
            order = np.argsort(key)
            active, key = active[order], key[order]
            return active, np.append(True, key[1:] != key[:-1])
        active, first = _regroup(active, key, base, rank)
        depth = reach


def _regroup(active: np.ndarray, key: np.ndarray, base: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts active by key, sets their ranks, returns those that share theirs. base: rank of the group that each was in."""
    order = np.argsort(key)
    active, key, base = active[order], key[order], base[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    outer = np.flatnonzero(np.append(True, base[1:] != base[:-1]))
    start = outer[np.searchsorted(outer, np.arange(len(base)), "right") - 1]
    rank[active] = base + first[group] - start
    shared = np.diff(np.append(first, len(active)))[group] > 1
    return active[shared], new[shared]


def kasai(data: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in order with the one before it, within their spans; 0 for the first.

    Kasai's recurrence by position: if p - 1 and p follow phi(p - 1) and phi(p - 1) + 1, the prefix is one byte
    shorter, as long as the one before has a byte. Only the heads of such runs are compared byte by byte; a run
    ends after a place without a common byte, and the next place is a head again.
    """
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    p, q = order[1:], order[:-1]
    by = np.argsort(p)
    p, q = p[by], q[by]
    head = np.append(True, (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1) | (end[p[1:]] != end[p[:-1]]) | (end[q[1:]] != end[q[:-1]]))
    at = np.flatnonzero(head)
    stop = np.append(at[1:], len(p))
    out = np.zeros(len(p), np.int64)
    while len(at):
        value = np.zeros(len(at), np.int64)
        for lo in range(0, len(at), 2048):
            a, b = p[at[lo : lo + 2048]], q[at[lo : lo + 2048]]
            most = np.minimum(end[a] - a, end[b] - b)
            width = int(most.max())
            j = np.arange(width)
            last = len(data) - 1
            same = (data[np.minimum(a[:, None] + j, last)] == data[np.minimum(b[:, None] + j, last)]) & (j < most[:, None])
            value[lo : lo + 2048] = np.where(same.all(1), width, same.argmin(1))
        size = np.minimum(value + 1, stop - at)
        run = np.repeat(np.arange(len(at)), size)
        away = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        out[at[run] + away] = value[run] - away
        more = at + size < stop
        at, stop = (at + size)[more], stop[more]
    lcp[1:][by] = out
    return lcp


def repeated_windows(data: np.ndarray, at: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """For every byte: does a window start here, inside its span, that also starts elsewhere (weight: times that a span occurs)."""
    size = np.diff(at)
    end = np.repeat(at[1:], size)
    order, _ = suffix_order(data, end, length)
    found = np.zeros(len(data), bool)
    if len(order):
        near = kasai(data, end, order) >= length
        found[order[near]] = True
        found[order[:-1][near[1:]]] = True
    often = np.repeat(weight > 1, size)
    position = np.arange(len(data))
    return (found | often) & (position + length <= end)


def _intervals(found: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """For each span: int32 pairs (first byte, end) covered by the windows that start at found."""
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    span = np.searchsorted(at, lo, "right") - 1  # windows end with their span, so no run of starts crosses spans
    pairs = np.stack([lo - at[span], hi - at[span] + length - 1], 1).astype(np.int32)
    cuts = np.searchsorted(span, np.arange(len(at)))
    return [pairs[cuts[i] : cuts[i + 1]].ravel() for i in range(len(at) - 1)]


_SHARD_OUT = "key long, span long, pairs binary"


def _shard(rows: pa.Table, length: int) -> pa.RecordBatch:
    raw = rows.column("raw").to_pylist()
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    found = repeated_windows(data, at, rows.column("weight").to_numpy(), length)
    return pa.RecordBatch.from_arrays([rows.column("key").combine_chunks(), rows.column("span").combine_chunks(), binaries(_intervals(found, at, length))], names=["key", "span", "pairs"])


def _whole_keys(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of whole (key, salt) groups, of about limit bytes, from rows in that order."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        while rows.num_rows:
            key, salt = rows.column("key").to_numpy(), rows.column("salt").to_numpy()
            if held:
                k, s = held[-1].column("key")[-1].as_py(), held[-1].column("salt")[-1].as_py()
                if sum(x.nbytes for x in held) >= limit:
                    same = int(((key == k) & (salt == s)).cumprod().sum())
                    held.append(rows.slice(0, same))
                    rows = rows.slice(same)
                    if rows.num_rows:
                        yield pa.concat_tables(held)
                        held = []
                    continue
            size = np.cumsum([len(x) for x in rows.column("raw").to_pylist()])
            n = max(1, int(np.searchsorted(size, limit)) + 1)
            held.append(rows.slice(0, n))
            rows = rows.slice(n)
    if held:
        yield pa.concat_tables(held)


def _fingerprints(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(at[:-1], at[1:], strict=True)])
    return start, anchors.range_hash(anchors.prefix_hash(data), start, start + length)


def across(parts: DataFrame, length: int) -> DataFrame:
    """(key, span, pairs) of windows that several shards of one key have. parts: key, salt, salts, span, raw."""

    def sorted_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_keys(batches, 1):
            raw = rows.column("raw").to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
            marks = np.unique(_fingerprints(np.frombuffer(b"".join(raw), np.uint8), at, length)[1])
            key, salt, salts = (rows.column(c)[0].as_py() for c in ("key", "salt", "salts"))
            splitters = np.array([(i << 64) // salts for i in range(1, salts)], U64)
            blobs = np.split(marks, np.searchsorted(marks, splitters))
            yield pa.RecordBatch.from_arrays([pa.array([key] * salts), pa.array([salt] * salts, pa.int32()), pa.array(range(salts), pa.int32()), binaries(blobs)], names=["key", "salt", "part", "marks"])

    def merge(group: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, U64) for x in group.column("marks").to_pylist()]
        every = np.sort(np.concatenate(blobs))
        keep = [x[np.searchsorted(every, x, "right") - np.searchsorted(every, x) > 1] for x in blobs]
        return pa.table({"key": group.column("key"), "salt": group.column("salt"), "marks": pa.chunked_array([binaries(keep)])})

    def mark(rows: pa.Table, found: pa.Table) -> pa.Table:
        raw = rows.column("raw").to_pylist()
        at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        data = np.frombuffer(b"".join(raw), np.uint8)
        marks = np.sort(np.concatenate([np.frombuffer(x, U64) for x in found.column("marks").to_pylist()] or [np.zeros(0, U64)]))
        hit = np.zeros(len(data), bool)
        if len(marks) and len(data):
            start, own = _fingerprints(data, at, length)
            where = np.minimum(np.searchsorted(marks, own), len(marks) - 1)
            hit[start[marks[where] == own]] = True
        return pa.table({"key": rows.column("key"), "span": rows.column("span"), "pairs": pa.chunked_array([binaries(_intervals(hit, at, length))])})

    ranges = mapped(parts.repartition("key", "salt").sortWithinPartitions("key", "salt"), sorted_ranges, "key long, salt int, part int, marks binary")
    merged = ranges.groupBy("key", "part").applyInArrow(merge, "key long, salt int, marks binary")
    return parts.groupBy("key", "salt").cogroup(merged.groupBy("key", "salt")).applyInArrow(mark, _SHARD_OUT)


def anchored(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, span, tid, at): runs of windows by anchor. texts: (tid, text). at: first byte * 1024 + number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            ids, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            new = np.sort(first[~np.isin(ids, seen)])  # copies are settled by their tid
            seen = np.union1d(seen, ids)
            batch = batch.take(pa.array(new))
            tids = batch.column(0).to_numpy()
            for lo, hi, data, at in slices(batch.column(1)):
                doc, start, count, owner, h, prefix = anchors.runs(data, at, length, gram)
                span = mix(anchors.range_hash(prefix, start, start + count + length - 1) + owner.astype(U64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(span.view(np.int64)), pa.array(tids[lo:hi][doc]), pa.array((start - at[doc]) * 1024 + count)], names=["key", "span", "tid", "at"])

    return mapped(texts, run, "key long, span long, tid long, at long")


def spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(tid, whole, cuts): for texts that lose bytes, whether all goes, or binary int32 pairs of what goes, maximal and in order.

    texts: (tid, text), a row for each text of length bytes at least.
    """
    copies = texts.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid")
    runs = anchored(texts, length, gram)
    shared = cut(runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))  # a join with a plain exchange on both sides can be split
    runs = cut(runs.join(shared, "key"))
    kinds = cut(runs.groupBy("key", "span").agg(F.count("*").alias("weight"), F.min_by("tid", F.col("tid")).alias("tid"), F.min_by("at", F.col("tid")).alias("at")))
    mixed = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key", F.ceil(F.col("kinds") / SHARD_RUNS).cast("int").alias("salts"))
    wanted = kinds.join(mixed, "key").withColumn("salt", F.pmod(F.xxhash64("span"), F.col("salts")).cast("int"))
    fetched = wanted.groupBy("tid").agg(F.collect_list(F.struct("key", "span", "at", "weight", "salts", "salt")).alias("wants"))
    held = fetched.join(texts, "tid").select("wants", "text")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            raws = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                raw, wants = raws[i].as_py(), batch.column(0)[i].as_py()
                wants = [w for w in wants if (w["key"], w["span"]) not in done]
                done.update((w["key"], w["span"]) for w in wants)  # copies of a text lie in one or few tasks
                cuts = [raw[w["at"] >> 10 : (w["at"] >> 10) + (w["at"] & 1023) + length - 1] for w in wants]
                if wants:
                    yield pa.RecordBatch.from_arrays([pa.array([w[c] for w in wants], t) for c, t in (("key", pa.int64()), ("span", pa.int64()), ("weight", pa.int64()), ("salts", pa.int32()), ("salt", pa.int32()))] + [pa.array(cuts, pa.binary())], names=["key", "span", "weight", "salts", "salt", "raw"])

    parts = cut(mapped(held, fetch, "key long, span long, weight long, salts int, salt int, raw binary").dropDuplicates(["key", "span"]))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_keys(batches, CHUNK_BYTES):
            yield _shard(rows, length)

    local = mapped(parts.repartition("key", "salt").sortWithinPartitions("key", "salt"), shard, _SHARD_OUT)
    split = across(parts.where("salts > 1"), length)
    pairs = local.union(split).where(F.octet_length("pairs") > 0)
    first, many = F.floor(F.col("at") / 1024), F.col("at") % 1024
    equal = kinds.where("weight > 1").select("key", "span")
    whole_runs = runs.join(equal, ["key", "span"], "left_semi").select("tid", first.alias("base"), F.lit(None).cast("binary").alias("pairs"), (many + length - 1).alias("size"))
    part_runs = runs.join(pairs, ["key", "span"]).select("tid", first.alias("base"), "pairs", F.lit(0).cast("long").alias("size"))
    cuts = whole_runs.union(part_runs).groupBy("tid").agg(F.collect_set(F.struct("base", "pairs", "size")).alias("cuts"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                found = []
                for c in value.as_py():
                    found.append(np.array([[c["base"], c["base"] + c["size"]]]) if c["pairs"] is None else np.frombuffer(c["pairs"], np.int32).reshape(-1, 2) + c["base"])
                out.append(merged_spans(np.concatenate(found)).astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries(out)], names=["tid", "cuts"])

    settled = mapped(cuts, settle, "tid long, cuts binary")
    return settled.join(copies.withColumn("whole", F.lit(True)), "tid", "full_outer").select("tid", F.coalesce("whole", F.lit(False)).alias("whole"), "cuts")


def merged_spans(found: np.ndarray) -> np.ndarray:
    """Maximal runs of the bytes that the (start, end) rows cover."""
    found = found[np.argsort(found[:, 0], kind="stable")]
    reach = np.maximum.accumulate(found[:, 1])
    new = np.append(True, found[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([found[first, 0], reach[np.append(first[1:], len(found)) - 1]], 1)


def _located(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """docs without text, with __whole and __cuts (what spans found) and __raw: the text's bytes, null for a null text."""
    own = docs.withColumn("__tid", F.when(F.octet_length(text) >= length, F.xxhash64(text)))
    texts = own.where("__tid IS NOT NULL").select(F.col("__tid").alias("tid"), F.col(text).alias("text"))
    found = cut(spans(texts, length, gram)).select(F.col("tid").alias("__tid"), F.col("whole").alias("__whole"), F.col("cuts").alias("__cuts"))
    return own.join(found, "__tid", "left").withColumn("__raw", F.col(text).cast("binary")).select(*docs.columns, "__whole", "__cuts", "__raw").drop(text)


def _left(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[int], list[int]]]:
    """(rows, bytes left, bytes before, runs removed) of a batch of _located, in slices, so that what is left of a batch is never held as a whole."""
    whole, cuts = batch.column(batch.num_columns - 3), batch.column(batch.num_columns - 2)
    for lo, hi, data, at in slices(batch.column(batch.num_columns - 1)):
        kept, parts = [], []
        for i in range(hi - lo):
            raw, found = data[at[i] : at[i + 1]].tobytes(), cuts[lo + i].as_py()
            pairs = [[0, len(raw)]] if whole[lo + i].as_py() else np.frombuffer(found, np.int32).reshape(-1, 2).tolist() if found else []
            end, left = 0, []
            for a, b in pairs:
                left.append(raw[end:a])
                end = b
            left.append(raw[end:])
            kept.append(b"".join(left))
            parts.append(len(pairs))
        yield batch.slice(lo, hi - lo), kept, np.diff(at).tolist(), parts


def dedup_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with __kept (binary: the bytes left), __n_bytes, __n_removed, __n_spans; null texts count as empty."""
    located = _located(docs, text, length, gram)
    names = located.columns[:-3]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in located.schema.fields[:-3]] + ["__kept binary", "__n_bytes long", "__n_removed long", "__n_spans long"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, kept, size, parts in _left(batch):
                gone = [n - len(k) for n, k in zip(size, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(names))] + [pa.array(kept, pa.binary())] + [pa.array(x, pa.int64()) for x in (size, gone, parts)], names=[*names, "__kept", "__n_bytes", "__n_removed", "__n_spans"])

    return mapped(located, apply, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    done = dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with the bytes that repeat removed from text; a null text stays null, a character cut apart goes whole.

    One pass over the text: a second one after dedup_spans would hold another Python worker, with a batch of its own, for each core.
    """
    located = _located(docs, text, length, GRAM)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, kept, _, _ in _left(batch):
                none = rows.column(rows.num_columns - 1).is_null().to_pylist()
                texts = pa.array([None if n else k.decode("utf-8", "ignore") for k, n in zip(kept, none, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([texts if c == text else rows.column(rows.schema.get_field_index(c)) for c in names], names=names)

    return mapped(located, run, docs.schema)
