"""SentencePiece encoding and decoding: segmentations sampled by forward filtering and backward sampling.

The lattice of a chunk (spaces and the word after them) has an edge for every vocabulary piece that fits; a
segmentation has a probability in proportion to the product of its pieces' weights. The weight of a piece is (rank + 1) ** -alpha,
as the vocabulary is ordered by merges and carries no probabilities. Sums over all ways to reach a place are filtered forward once for each
distinct chunk of a slice; then every occurrence is sampled backward, from a counter-based generator that is
seeded by the row's key and the place of the chunk, so the same key and text give the same pieces on any cluster.
Characters without a piece go by bytes (one edge of byte pieces), as does the piece's own space mark, so decoding is lossless.

Scale: one pass without a shuffle; the vocabulary (32,000 pieces) is read from a parameter's path and sent with the
function. Everything is numpy over all chunks of a slice at once; loops run over piece lengths and places in a chunk.

Defined cases: a null text gives null pieces and decodes to null, an empty one to no pieces and ''; a null key counts as its own key;
repeated rows (same key and text) give the same pieces; ties do not arise (sampling); very long texts and chunks are whole; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import inverses
from .common import U64, mapped, mix, powers, table, without

SPACE = "▁"
ALPHA = 1.0
#: Characters that are encoded at once.
SLICE_CHARS = 3 << 18
MODEL = os.environ.get("SIFTLINE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


class Pieces:
    """A vocabulary: pieces by hash, prefixes of pieces by hash, weights and byte pieces."""

    def __init__(self, pieces: list[str], normal: list[bool], byte_ids: list[int], alpha: float = ALPHA):
        self.pieces, self.byte_ids = pieces, np.array(byte_ids, np.int64)
        use = [i for i, (p, ok) in enumerate(zip(pieces, normal, strict=True)) if ok and p]
        ranks = np.arange(len(use))
        self.log_weight = np.full(len(pieces), -alpha * np.log(len(use) + 1.0))
        self.log_weight[use] = -alpha * np.log(ranks + 1.0)
        self.longest = max((len(pieces[i]) for i in use), default=1)
        whole = {pieces[i]: i for i in use}
        prefixes = sorted({p[:n] for p in whole for n in range(1, len(p) + 1)})
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # for each length: sorted hashes of prefixes, piece ids (-1: a prefix only)
        for n in range(self.longest + 1):
            own = [p for p in prefixes if len(p) == n]
            hashes = np.array([hash_of(p) for p in own], U64)
            order = np.argsort(hashes)
            self.tables.append((hashes[order], np.array([whole.get(p, -1) for p in own], np.int64)[order]))
            if len(hashes) != len(np.unique(hashes)):
                raise ValueError("two pieces have one hash")

    @classmethod
    def load(cls, path: str = MODEL, alpha: float = ALPHA) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        return cls([model.id_to_piece(i) for i in range(n)], normal, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], alpha)

    def find(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each hash of length characters; -1 for a mere prefix, -2 for neither."""
        known, piece = self.tables[length]
        if not len(known):
            return np.full(len(hashes), -2)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, piece[at], -2)

    def decode(self, ids: np.ndarray) -> str:
        out, back = [], {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        for i in ids.tolist():
            out.append(back[i] if i in back else self.pieces[i].replace(SPACE, " ").encode("utf-8", "surrogatepass"))
        return b"".join(out).decode("utf-8", "surrogatepass")


def _letters(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U64) + U64(1))


def hash_of(piece: str) -> int:
    codes = np.array([0x20 if c == SPACE else ord(c) for c in piece], np.uint32)
    return int(mix((_letters(codes) * powers(len(codes))[: len(codes)]).sum(dtype=U64)[None])[0])


def chunks(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First places of the chunks: texts' first places, spaces after a non-space, and line breaks with their neighbours apart."""
    n = len(codes)
    space, line = codes == 0x20, codes == 0x0A
    first = np.zeros(n, bool)
    first[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    first[starts[starts < n]] = True
    return np.flatnonzero(first)


def distinct(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the distinct chunks, a representative of each, distinct number of each chunk)."""
    size = np.diff(np.append(first, len(codes)))
    inner = np.arange(len(codes)) - np.repeat(first, size)
    h = mix(np.add.reduceat(_letters(codes) * powers(int(size.max()) + 1)[inner], first) + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(h)
    new = np.append(True, h[order[1:]] != h[order[:-1]])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return h[order[new]], order[new], number


class Lattice:
    """Edges into every place of the distinct chunks, with cumulative backward probabilities."""

    def __init__(self, pieces: Pieces, codes: np.ndarray, first: np.ndarray):
        size = np.diff(np.append(first, len(codes)))
        n = len(codes)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_letters(codes) * powers(n + 1)[:n], out=sums[1:])
        back = inverses(n + 1)
        place = np.arange(n) - np.repeat(first, size)
        room = np.repeat(size, size) - place
        live = np.flatnonzero((codes != ord(SPACE)))
        starts, ends, ids = [], [], []
        for length in range(1, pieces.longest + 1):
            live = live[room[live] >= length]
            if not len(live):
                break
            found = pieces.find(length, mix((sums[live + length] - sums[live]) * back[live]))
            hit = found >= 0
            starts.append(live[hit])
            ends.append(live[hit] + length)
            ids.append(found[hit])
            live = live[found > -2]
        alone = np.ones(n, bool)
        if starts:
            alone[starts[0]] = False
        alone = np.flatnonzero(alone)  # no piece of one character: bytes
        starts.append(alone)
        ends.append(alone + 1)
        ids.append(np.full(len(alone), -1))
        start, end, piece = (np.concatenate(x) for x in (starts, ends, ids))
        weight = np.where(piece >= 0, pieces.log_weight[piece], 4 * pieces.log_weight.min())
        order = np.argsort(end * (pieces.longest + 1) + (end - start))
        self.start, self.end, self.piece, weight = start[order], end[order], piece[order], weight[order]
        # Forward filtering, all chunks at once by place of the edge's end in its chunk.
        chunk_of = np.repeat(np.arange(len(first)), size)
        depth = self.end - first[chunk_of[self.end - 1]]
        inner = self.start != first[chunk_of[self.start]]
        probability = np.empty(len(self.start))
        by_depth = (depth << 32) | np.arange(len(depth))
        by_depth.sort()
        cuts = np.searchsorted(by_depth, np.arange(1, int(depth.max()) + 2) << 32)
        by_depth &= (1 << 32) - 1
        reach = np.full(n + 1, -np.inf)  # of places after a chunk's first; a chunk's first is 0
        for d in range(len(cuts) - 1):
            edges = by_depth[cuts[d] : cuts[d + 1]]
            score = weight[edges] + np.where(inner[edges], reach[self.start[edges]], 0.0)
            to = self.end[edges]
            head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            many = np.diff(np.append(head, len(to)))
            top = np.maximum.reduceat(score, head)
            part = np.exp(score - np.repeat(top, many))
            sums_ = np.add.reduceat(part, head)
            probability[edges] = part / np.repeat(sums_, many)
            reach[to[head]] = top + np.log(sums_)
        head = np.flatnonzero(np.append(True, self.end[1:] != self.end[:-1]))
        many = np.diff(np.append(head, len(self.end)))
        # Cumulative probabilities of each place on its own, on a grid of 2 ** -24: the same wherever the chunk lies in a slice.
        self.mark = np.empty(len(self.end))
        for lo in range(0, len(head), 1 << 16):
            at, n_in = head[lo : lo + (1 << 16)], many[lo : lo + (1 << 16)]
            first_edge, row = at[0], np.repeat(np.arange(len(at)), n_in)
            rank = np.arange(len(row)) + first_edge - np.repeat(at, n_in)
            grid = np.zeros((len(at), int(n_in.max())))
            grid[row, rank] = probability[first_edge : first_edge + len(row)]
            self.mark[first_edge : first_edge + len(row)] = np.minimum(np.floor(np.cumsum(grid, 1)[row, rank] * 2**24), 2**24 - 1)
        self.mark[head + many - 1] = 2**24 - 1
        self.mark = self.end + (self.mark + 0.5) * 2.0**-24
        self.codes, self.first, self.size = codes, first, size

    def sample(self, number: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, ...]:
        """(occurrence, place in the chunk, piece or -1, character) of the sampled edges."""
        at, low = self.first[number] + self.size[number], self.first[number]
        who = np.arange(len(number))
        out_who, out_edge, step = [who[:0]], [who[:0]], 0
        while len(who):
            step += 1
            u = (mix(seed[who] + U64(step * 0xD1B54A32D192ED03 % 2**64)) >> U64(40)).astype(np.float64) * 2.0**-24
            edge = np.searchsorted(self.mark, at[who] + u)
            out_who.append(who)
            out_edge.append(edge)
            at[who] = self.start[edge]
            who = who[at[who] > low[who]]
        who, edge = np.concatenate(out_who), np.concatenate(out_edge)
        start = self.start[edge]
        return who, start - low[who], self.piece[edge], self.codes[start]


class Encoder:
    """Samples piece ids; keeps the lattice of the first slice's chunks, so that later slices build only new ones."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: tuple[np.ndarray, Lattice] | None = None

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Sampled piece ids of each text; keys: a 64-bit seed for each."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        size = np.array([len(c) for c in codes], np.int64)
        if not size.sum():
            return [np.zeros(0, np.int32) for _ in texts]
        whole = np.concatenate(codes)
        begin = np.cumsum(size) - size
        first = chunks(whole, begin[size > 0])
        doc = np.flatnonzero(size > 0)[np.searchsorted(begin[size > 0], first, "right") - 1]
        seed = mix(keys[doc] ^ mix((first - begin[doc]).astype(U64)))
        hashes, pick, number = distinct(whole, first)
        found = np.full(len(hashes), -1)
        if self.known is not None:
            at = np.minimum(np.searchsorted(self.known[0], hashes), len(self.known[0]) - 1)
            found = np.where(self.known[0][at] == hashes, at, -1)
        new = np.flatnonzero(found < 0)
        parts = []
        if len(new):
            length = np.diff(np.append(first, len(whole)))[pick[new]]
            own_first = np.cumsum(length) - length
            own = whole[np.repeat(first[pick[new]] - own_first, length) + np.arange(int(length.sum()))]
            lattice = Lattice(self.pieces, own, own_first)
            place = np.full(len(hashes), -1)
            place[new] = np.arange(len(new))
            parts.append((np.flatnonzero(place[number] >= 0), place, lattice))
            if self.known is None:
                self.known = hashes, lattice
        if len(new) < len(hashes):
            parts.append((np.flatnonzero(found[number] >= 0), found, self.known[1]))
        out = []
        for rows, place, lattice in parts:
            who, start, piece, code = lattice.sample(place[number[rows]], seed[rows])
            out.append((rows[who], start, piece, code))
        who, start, ids, code = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(who * (int(start.max()) + 1) + start)
        ids, code, owner = ids[order], code[order], doc[who[order]]
        fallback = np.flatnonzero(ids < 0)
        if len(fallback):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[fallback].tolist()]
            many = np.ones(len(ids), np.int64)
            many[fallback] = [len(r) for r in raw]
            bytes_ = self.pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            at = np.repeat(np.cumsum(many)[fallback] - many[fallback], many[fallback])
            at = at + np.arange(len(at)) - np.repeat(np.cumsum(many[fallback]) - many[fallback], many[fallback])
            ids, owner = np.repeat(ids, many), np.repeat(owner, many)
            ids[at] = bytes_
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        ids = ids.astype(np.int32)
        return [ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


def encode(pieces: Pieces, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    return Encoder(pieces).encode(texts, keys)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = MODEL, alpha: float = ALPHA, digest: bool = False) -> DataFrame:
    """docs with piece_ids; with digest, instead: n_pieces, ids_crc32 (of little-endian int32 ids) and lossless (decoding gives the text). Columns of these names are replaced."""
    pieces = Pieces.load(path, alpha)
    seed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0")))
    docs = without(docs, "piece_ids", "n_pieces", "ids_crc32", "lossless", "__seed")
    names = docs.columns
    extra = "n_pieces long, ids_crc32 long, lossless boolean" if digest else "piece_ids array<int>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [extra])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            seeds = batch.column(len(names)).to_numpy().view(U64)
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < SLICE_CHARS):
                    size += len(texts[hi] or "")
                    hi += 1
                part = texts[lo:hi]
                ids = encoder.encode([t or "" for t in part], seeds[lo:hi])
                own = [c.slice(lo, hi - lo) for c in batch.columns[: len(names)]]
                null = np.array([t is None for t in part])
                if digest:
                    more = [pa.array([len(x) for x in ids], pa.int64(), mask=null), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64(), mask=null), pa.array(lossless(pieces, part, ids), pa.bool_(), mask=null)]
                else:
                    ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                    more = [pa.ListArray.from_arrays(pa.array(ends, mask=np.append(null, False)) if null.any() else pa.array(ends), pa.array(np.concatenate(ids)))]
                yield pa.RecordBatch.from_arrays(own + more, names=names + [x.split()[0] for x in extra.split(", ")])
                lo = hi

    return mapped(docs.withColumn("__seed", seed), run, schema)


def decode_all(pieces: Pieces, ids: list[np.ndarray]) -> list[bytes]:
    """UTF-8 bytes of each list of ids: one gather over the vocabulary's bytes."""
    back = {int(i): bytes([b]) for b, i in enumerate(pieces.byte_ids)}
    raw = [back.get(i, p.replace(SPACE, " ").encode("utf-8", "surrogatepass")) for i, p in enumerate(pieces.pieces)]
    size = np.array([len(r) for r in raw], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(raw), np.uint8)
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    many = size[every]
    ends = np.cumsum(many)
    out = data[np.repeat(start[every] - (ends - many), many) + np.arange(int(many.sum()))].tobytes()
    cuts = np.append(0, ends)[np.append(0, np.cumsum([len(x) for x in ids]))]
    return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def lossless(pieces: Pieces, texts: list[str | None], ids: list[np.ndarray]) -> list[bool]:
    return [raw == (t or "").encode("utf-8", "surrogatepass") for raw, t in zip(decode_all(pieces, ids), texts, strict=True)]


def decoded(docs: DataFrame, ids: str = "piece_ids", path: str = MODEL) -> DataFrame:
    """docs with decoded (the text of the ids; null for null) instead of a column of that name."""
    pieces = Pieces.load(path)
    docs = without(docs, "decoded")
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["decoded string"])
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.zeros(0, np.int64) if v is None else np.array(v, np.int64) for v in batch.column(at).to_pylist()]
            texts = [x.decode() for x in decode_all(pieces, values)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=np.array([not v.is_valid for v in batch.column(at)]))], names=[*names, "decoded"])

    return mapped(docs, run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and lossless of every document's sampled pieces."""
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).drop("text")
