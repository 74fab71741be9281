"""Near-duplicates: BagMinHash signatures of five-word shingle multisets, banding, and exact multiset overlap.

Every text is its multiset of five-word windows of the lower-cased text (a text of one to four words is
one window). A signature slot keeps the earliest point of a Poisson process. The process of a shingle runs
over (time, weight): dyadic weight bands (0, 1], (1, 2], (2, 4], ... each have a rate equal to their width, and
a point counts if its unit weight cell is within the shingle's count. So two texts agree in a slot with the
probability of their weighted Jaccard similarity, and a large count costs its logarithm in bands. All points
up to a time at which every slot is likely full are made in numpy for a whole slice of texts at once.

Scale: equal texts share one id (64-bit hash), so copies never meet in pairs. A band bucket links its members
to one hub (the member with most bucket mates), never to each other. A connected
area of more than AREA such candidates whose members verified links do not join is cut up by prefix filter: two similar bags share one of their 20 % + 1
shingles that are rarest in the area, so only members that share one of those, across what is joined, stay in one area. Pages of one template, alike in their
frequent shingles alone, fall apart here, in work that grows with their number. What is still mixed is compared exactly,
in tiles of bounded size with a posting list each, so that no link is lost to the hub's choice; only links
that join something new leave a tile. That last step grows with the square of an area of texts that are chained by a similarity just below the threshold. Verification reads 32-bit shingle hashes of the two texts. Components are found by
star contraction over DataFrames with checkpoints.

Defined cases: a null text, or one without words, is in a class of its own; a null doc_id keeps its row, and a
class's id is its least non-null doc_id (null if it has none); repeated rows are copies; an empty table gives an
empty result; other columns are carried along by near_dedup and never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, binaries, components, cut, map_arrow, mapped, mix, shingles, slices, span_hashes, table, words, written

SLOTS, BANDS, ROWS = 160, 32, 5
SIMILARITY = 0.8
#: Texts of one area of candidates that a task compares at once (with as many others), and of an area that is not cut up first.
TILE, AREA = 2048, 4096
_STEP, _SLOT = U64(0xD1B54A32D192ED03), U64(0x8CB92BA72F3D8DD7)


def multisets(data: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle hash, text number, count), sorted by text."""
    n = len(at) - 1
    starts, ends, doc = words(data, at)
    h, of = shingles(span_hashes(data, starts, ends), doc, n, k)
    key = (of.astype(U64) << U64(44)) | (h >> U64(20))  # 44 bits of the hash, told apart within a text only
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    found = key[first]
    return mix(found & U64((1 << 44) - 1)), (found >> U64(44)).astype(np.int64), np.diff(np.append(first, len(key)))


def signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """(n_docs, slots) of 64-bit signature values; texts without shingles have zeros."""
    band_of = np.ceil(np.log2(weight)).astype(np.int64)
    copies = band_of + 1
    entry = np.repeat(np.arange(len(h)), copies)
    band = np.arange(len(entry)) - np.repeat(np.cumsum(copies) - copies, copies)
    seed, of = mix(h[entry] + band.astype(U64) * _SLOT), doc[entry]
    rate = np.where(band == 0, 1, 1 << np.maximum(band - 1, 0)).astype(np.float64)
    room = weight[entry] - np.where(band == 0, 0, rate)  # unit cells of this band that count
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    until = slots * (math.log(slots) + 3) / np.maximum(total, 1)
    out = np.full(n_docs * slots, np.inf)
    todo = np.flatnonzero(total[of] > 0)
    while len(todo):
        s, r, o, limit, cells = seed[todo], rate[todo], of[todo], until[of[todo]], room[todo]
        time, j = np.zeros(len(todo)), 0
        while len(s):
            ahead = np.arange(j + 1, j + 1 + max(1, min(64, 8192 // len(s))), dtype=U64) * _STEP  # points made at once
            j += len(ahead)
            u = mix(s[:, None] + ahead)
            gap = np.log(((u >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            step = -gap / r[:, None]
            step[:, 0] += time
            times = np.cumsum(step, 1)  # sums run on from the start, so how many points are made at once changes no bit
            v = mix(u ^ _SLOT)
            fits = (times <= limit[:, None]) & ((v >> U64(40)).astype(np.float64) * 2.0**-24 * r[:, None] < cells[:, None])
            slot = (v & U64(0xFFFFFF)).astype(np.int64) % slots + (o * slots)[:, None]
            np.minimum.at(out, slot[fits], times[fits])
            on = times[:, -1] <= limit
            s, r, o, limit, cells, time = s[on], r[on], o[on], limit[on], cells[on], times[on, -1]
        open_docs = np.isinf(out.reshape(n_docs, slots)).any(1) & (total > 0)
        until[open_docs] *= 2
        out.reshape(n_docs, slots)[open_docs] = np.inf
        todo = todo[open_docs[of[todo]]]
    out[np.isinf(out)] = 0
    return mix(out.view(U64)).reshape(n_docs, slots)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, bands) of bucket keys."""
    part = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * _STEP, (len(sig), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key ^ part[:, :, j])
    return key.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(tid, n, keys, bag) from (tid, text): one row for each tid of a task, none for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            ids, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            new = np.sort(first[~np.isin(ids, seen)])
            seen = np.union1d(seen, ids)
            batch = batch.take(pa.array(new))
            tids = batch.column(0).to_numpy()
            for lo, hi, data, at in slices(batch.column(1)):
                n = hi - lo
                h, doc, count = multisets(data, at)
                sig = signatures(h, doc, count, n)
                short = np.repeat((h >> U64(32)) | (doc.astype(U64) << U64(32)), count)
                short.sort()
                size = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
                ends = np.cumsum(size)
                bag = (short & U64(0xFFFFFFFF)).astype(np.uint32)
                has = np.flatnonzero(size > 0)
                keys = band_keys(sig[has])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tids[lo:hi][has]), pa.array(size[has]), flat, binaries([bag[ends[i] - size[i] : ends[i]] for i in has])],
                    names=["tid", "n", "keys", "bag"],
                )

    return mapped(docs, run, "tid long, n long, keys array<long>, bag binary")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets of uint32."""
    numbered = lambda x: (x.astype(U64) << U64(32)) | (np.arange(len(x)) - np.searchsorted(x, x)).astype(U64)
    x, y = numbered(a), numbered(b)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def verified(pairs: DataFrame, bags: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose multiset Jaccard similarity is similarity at least. bags: one row for each tid."""
    at_least = F.lit(similarity)
    sizes = bags.select("tid", "n")
    near = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(F.least("na", "nb") >= at_least * F.greatest("na", "nb")).select("a", "b")
    both = near.join(bags.select(F.col("tid").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("tid").alias("b"), F.col("bag").alias("y")), "b").select("a", "b", "x", "y")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bag = lambda v: np.frombuffer(v.as_buffer(), np.uint32)
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = bag(x), bag(y)
            both = overlap(p, q)
            keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def _unexplained(group: pa.Table, similarity: float = SIMILARITY) -> pa.Table:
    """Links between the components of a tile: exact overlaps, from one posting list, of every text outside the largest component.

    Sides 0 and 1 are compared with each other, side 2 with itself. Links that join nothing new are not returned.
    """
    side, tid, size = (group.column(c).to_numpy() for c in ("side", "tid", "n"))
    _, comp = np.unique(group.column("comp").to_numpy(), return_inverse=True)
    bags = [np.frombuffer(x, np.uint32) for x in group.column("bag").to_pylist()]
    owner = np.repeat(np.arange(len(bags)), size)
    item = np.concatenate([(x.astype(U64) << U64(32)) | (np.arange(len(x)) - np.searchsorted(x, x)).astype(U64) for x in bags])  # hash and how many times before
    order = np.argsort(item, kind="stable")
    posted, holder = item[order], owner[order]
    starts = np.cumsum(size) - size
    parent = np.arange(int(comp.max()) + 1)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i in np.flatnonzero(comp != np.bincount(comp).argmax()):
        own = item[starts[i] : starts[i] + size[i]]
        lo, hi = np.searchsorted(posted, own), np.searchsorted(posted, own, "right")
        many = hi - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        both = np.bincount(holder[at], minlength=len(bags))
        ok = both >= similarity * (size + size[i] - both) - 1e-9
        ok &= (side == 2) if side[i] == 2 else (side == 1 - side[i])
        for j in np.flatnonzero(ok):
            x, y = find(comp[i]), find(comp[j])
            if x != y:
                parent[x] = y
                a.append(min(tid[i], tid[j]))
                b.append(max(tid[i], tid[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _mixed(placed: DataFrame) -> DataFrame:
    """(area, size) of the areas that verified links do not join."""
    return placed.groupBy("area").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("area", "size")


def refined(placed: DataFrame, bags: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """placed (tid, area, comp) in smaller areas, which still hold every similar pair of one area across two comps; texts without such a candidate are left out.

    A bag of n with similarity s to another shares s * n with it at least, so the n - ceil(s * n) + 1 first of each, in any one order, have an element in common. The order
    is by how many texts of the area have an element (which counts repeats apart), then by its value; an element of one text only is in front and never shared.
    """

    def elements(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint32)
            item = (x.astype(U64) << U64(32)) | (np.arange(len(x)) - np.searchsorted(x, x)).astype(U64)
            key = mix(mix(item) ^ U64(batch.column(1)[i].as_py() & (2**64 - 1)))  # of element and area; one that stands for two only adds candidates
            row = pa.array(np.full(len(x), i, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array(key.view(np.int64))], names=["tid", "n", "key"])

    held = map_arrow(placed.join(bags, "tid").select("tid", "area", F.col("n").cast("int").alias("n"), "bag"), elements, "tid long, n int, key long")
    common = cut(held.groupBy("key").agg(F.count("*").cast("int").alias("texts")).where("texts > 1"))
    by = Window.partitionBy("tid")
    known = held.join(common, "key").withColumns({"place": F.row_number().over(by.orderBy("texts", "key")), "known": F.count("*").over(by)})
    first = known.where(F.col("place") <= F.col("known") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).select("tid", "key")  # the n - known others come before
    first = cut(first.join(placed.select("tid", "comp"), "tid"))
    bucket = cut(first.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("tid").alias("hub")).where("lo < hi").select("key", "hub"))
    met = components(first.join(bucket, "key").select(F.col("tid").alias("a"), F.col("hub").alias("b")).distinct())
    return placed.select("tid", "comp").join(met.toDF("tid", "area"), "tid")


def links(docs: DataFrame) -> DataFrame:
    """(a, b): similar pairs of distinct texts that connect every class. docs has tid and text."""
    made = written(signed(docs), "bagminhash")
    rows = made.select("tid", F.explode("keys").alias("key")).distinct()
    shared = rows.groupBy("key").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.count("*").alias("mates")).where("lo < hi").select("key", "mates")
    member = cut(rows.join(shared, "key"))
    degree = member.groupBy("tid").agg(F.sum("mates").alias("degree"))
    order = F.col("degree") * F.lit(1 << 20) + F.pmod(F.xxhash64("tid"), F.lit(1 << 20))
    hub = member.join(degree, "tid").groupBy("key").agg(F.max_by("tid", order).alias("hub"))
    star = member.join(hub, "key").where("tid <> hub").select(F.least("tid", "hub").alias("a"), F.greatest("tid", "hub").alias("b")).distinct()
    known = degree.select("tid")
    bags = cut(made.select("tid", "n", "bag").join(known, "tid", "left_semi").dropDuplicates(["tid"]))
    star = cut(star)
    first = cut(verified(star, bags))
    placed = components(star).toDF("tid", "area").join(components(first).toDF("tid", "root"), "tid", "left").select("tid", "area", F.coalesce("root", "tid").alias("comp"))
    placed = cut(placed.join(_mixed(placed), "area"))
    large = placed.where(F.col("size") > AREA).drop("size")
    placed = placed.where(F.col("size") <= AREA).select("tid", "comp", "area")
    if not large.isEmpty():
        placed = placed.union(refined(large, bags).select("tid", "comp", "area"))
    mixed = _mixed(placed).select("area", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    cell = lambda o: F.struct(F.least("tile", o).alias("i"), F.greatest("tile", o).alias("j"), F.when(F.col("tile") == o, 2).when(F.col("tile") < o, 0).otherwise(1).alias("side"))
    tiled = placed.join(mixed, "area").join(bags, "tid").withColumn("tile", F.pmod(F.xxhash64("tid"), F.col("tiles")).cast("int")).withColumn("cell", F.explode(F.transform(others, cell)))
    tiled = tiled.select("area", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), F.col("cell.side").alias("side"), "tid", "comp", "n", "bag")
    return first.union(tiled.groupBy("area", "i", "j").applyInArrow(lambda group: _unexplained(group), "a long, b long"))


def identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __tid: a hash of the text; null where the text has no words."""
    return docs.withColumn("__tid", F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(F.col(text))))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((tid, class_id, class_docs) of every text with words, (doc_id, tid) of every row)."""
    with_id = identified(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    rows = with_id.select("doc_id", F.col("__tid").alias("tid"))
    comp = components(links(with_id.where("__tid IS NOT NULL").select(F.col("__tid").alias("tid"), F.lower("text").alias("text"))))
    each = rows.where("tid IS NOT NULL").groupBy("tid").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"))
    rooted = each.join(comp.toDF("tid", "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    total = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("docs").alias("class_docs"))
    return rooted.join(total, "root").select("tid", "root", "class_id", "class_docs"), rows


def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of its near-duplicates), class_docs (documents in the class)."""
    found, rows = classes(table(spark, sf_dir, "documents"))
    alone = F.col("class_docs").isNull()
    return rows.join(found, "tid", "left").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_docs", F.lit(1)).alias("class_docs"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each class: the one with the least doc_id; all rows without words stay."""
    found, rows = classes(docs, doc_id, text)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    pick = rows.where("tid IS NOT NULL").join(found, "tid").groupBy("root").agg(F.min_by("tid", F.struct(F.col("doc_id").isNull(), "doc_id", "tid")).alias("__tid"), F.min("doc_id").alias("doc_id"))
    pick = pick.select("__tid", key.alias("__key"))
    names = docs.columns
    own = identified(docs, text).withColumn("__key", F.coalesce(F.col(doc_id), F.lit(-(1 << 63))))
    stay = own.where("__tid IS NOT NULL").join(pick, ["__tid", "__key"], "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy("__tid", "__key").orderBy(F.lit(0)))).where("__n = 1")
    return stay.select(*names).unionByName(own.where("__tid IS NULL").select(*names))
