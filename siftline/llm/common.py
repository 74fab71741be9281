"""Shared parts of the operators: shared-folder tables, Arrow batches as byte arrays, word hashing, components.

Everything here is either a plain DataFrame plan or a numpy routine over one Arrow batch, so that a task
holds one slice of text at a time, whatever the size of the corpus.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
SLICE_BYTES = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder; a cluster must name it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="siftline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


#: Paths of tables that written() made and nobody dropped, in order.
MADE: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_made(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of written() that no plan needs any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        MADE.remove(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (in any case), so that columns of these names can be added."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone)) if gone & {c.lower() for c in df.columns} else df


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int) -> np.ndarray:
    """Powers of the hash base, at least n of them; kept for small n."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        out = np.full(size, _BASE, U64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if size > 1 << 22:
            return out
        _POWERS[size] = out
    return _POWERS[size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column one after the other, and n + 1 offsets. Nulls count as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    n, lo = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[lo : lo + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of whole texts of about limit bytes; a longer text is a run alone."""
    data, at = text_bytes(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words: runs of bytes that are not white space (0x20, 0x09-0x0D)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SEPARATOR[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = at[1:-1]
    before[edge[edge < n]] = False
    edge = edge - 1
    after[edge[edge >= 0]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, non-empty byte spans."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    first = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(first, size)
    raw = data[np.repeat(starts, size) + inner].astype(U64) + U64(1)
    return mix(np.add.reduceat(raw * powers(int(size.max()) + 1)[inner], first) + size.astype(U64) * _BASE)


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word windows and their text numbers; a text of 1 to k - 1 words has one window, all of it."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    p = powers(k + 1)
    if len(hashes) >= k:
        h = np.zeros(len(hashes) - k + 1, U64)
        for j in range(k):
            h += hashes[j : len(hashes) - k + 1 + j] * p[j]
        whole = doc[: len(h)] == doc[k - 1 :]
        out, of = mix(h[whole]), doc[: len(h)][whole]
    else:
        out, of = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += hashes[first[short[has]] + j] * p[j]
        out, of = np.concatenate([out, mix(extra + count[short].astype(U64))]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def release() -> None:
    """Gives freed memory back to the system; Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow that hands memory back at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapped with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)

    return mapped(df, run, schema)


def binaries(parts: list[np.ndarray]) -> pa.Array:
    """Arrays as one binary column, without a Python object for each byte."""
    size = np.array([p.nbytes for p in parts], np.int64)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = np.concatenate([p.view(np.uint8) for p in parts]) if parts and at[-1] else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


#: Links of one task and file between the rounds of components.
LINKS = 1 << 17


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, root) of every node of the edges: root is the least node of its connected component.

    Alternating large-star and small-star steps over DataFrames; each halves the depth, so that a few rounds do even for long chains. Only a count and a sum of
    hashes of a round's links reach the driver: a round that changes neither is the last. Lineage is cut by checkpoints in the shared folder, also before
    the join in which a root meets all its links, so that adaptive execution can split it there. A round is written in files of about LINKS links,
    however many shuffle partitions there are: writing many tiny files costs more than their rows.
    """

    def few(links: DataFrame) -> DataFrame:
        return links.coalesce(max(1, -(-before[0] // LINKS)))

    def settled(links: DataFrame) -> tuple[DataFrame, tuple]:
        """links, written, and what tells them apart: counted while they are written."""
        seen = Observation()
        sums = (F.sum(F.xxhash64(*c).cast("decimal(38,0)")).alias(n) for n, c in (("a", ("u", "v")), ("b", ("v", "u"))))
        done = cut(links.observe(seen, F.count(F.lit(1)).alias("n"), *sums))
        return done, tuple(seen.get[k] for k in ("n", "a", "b"))

    now, before = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.union(now.select("v", "u"))
        least = cut(few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now, after = settled(few(small.where("u <> v").distinct()))
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
