import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import suffix_dedup as S


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    times = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            times[r[i : i + length]] = times.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        n_spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), n_spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def made(seed, n=60, alphabet="ab é"):
    rnd = random.Random(seed)
    bits = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([5, 30, 45, 80]))) for _ in range(25)]
    texts = ["".join(rnd.choice(bits) if rnd.random() < 0.6 else "".join(rnd.choice(alphabet + "cdefgh") for _ in range(20)) for _ in range(rnd.randrange(0, 9))) for _ in range(n)]
    return texts + [texts[3], texts[3], None, "", "a" * 300, "ab" * 90]


@pytest.mark.parametrize("seed,shard_runs", [(1, 4096), (2, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, shard_runs):
    monkeypatch.setattr(S, "SHARD_RUNS", shard_runs)
    texts = made(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tid string")
    rows = {r.doc_id: r for r in S.dedup_spans(docs, "text", 40, 12).collect()}
    for i, want in enumerate(brute(texts, 40)):
        r = rows[i]
        assert (r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) == want, i
        assert r.tid == "x"


def test_suffix_order_and_kasai():
    rnd = random.Random(5)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(900)), np.uint8)
    at = np.array([0, 300, 650, 900])
    got = S.repeated_windows(data, at, np.ones(3, int), 16)
    raw = data.tobytes()
    for p in range(900):
        end = at[np.searchsorted(at, p, "right")]
        if p + 16 > end:
            assert not got[p]
            continue
        w = raw[p : p + 16]
        times = sum(raw[q : q + 16] == w for a, b in zip(at[:-1], at[1:]) for q in range(a, b - 15))
        assert got[p] == (times > 1)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup_spans(docs).count() == 0


def test_query_hash(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 100), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in S.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert rows[1].kept_sha256 == hashlib.sha256(b"x" * 100).hexdigest() and rows[None].n_bytes == 0


def test_kasai_goes_on_after_one_differing_byte():
    rnd = random.Random(9)
    body = bytes(rnd.choice(b"bcdefghijk") for _ in range(320))
    lead = bytes(rnd.choice(b"bcdefghijk") for _ in range(40))
    runs = [lead + b"r" + body, lead + b"s" + body, lead + b"r" + body[:150] + b"a" * 120, lead + b"s" + body[:150] + b"z" * 120]
    at = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    got = S.repeated_windows(np.frombuffer(b"".join(runs), np.uint8), at, np.ones(4, int), 200)
    windows = [r[i : i + 200] for r in runs for i in range(len(r) - 199)]
    places = [a + i for a, r in zip(at, runs, strict=False) for i in range(len(r) - 199)]
    assert [bool(got[p]) for p in places] == [windows.count(w) > 1 for w in windows] and got.any()


def test_cleaned_is_one_pass_over_the_text(spark):
    texts = made(3)
    docs = spark.createDataFrame([(t, i, "x") for i, t in enumerate(texts)], "text string, doc_id long, tid string")
    done = S.cleaned(docs, length=60)
    assert done.columns == docs.columns
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # each pass holds a Python worker and a batch for each core
    want = {i: None if t is None else raw.decode("utf-8", "ignore") for i, (t, (_, _, _, raw)) in enumerate(zip(texts, brute(texts, 60), strict=True))}
    assert {r.doc_id: r.text for r in done.collect()} == want


def test_what_is_left_of_a_batch_comes_in_slices():
    raw = [b"a" * 700_000, None, b"b" * 700_000, b"c" * 10]
    cuts = [np.array([0, 5, 9, 10], np.int32).tobytes(), None, None, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([False, False, False, True]), pa.array(cuts, pa.binary()), pa.array(raw, pa.binary())], names=["doc_id", "__whole", "__cuts", "__raw"])
    found = list(S._left(batch))
    assert [rows.column(0).to_pylist() for rows, *_ in found] == [[0, 1], [2, 3]]
    assert [[len(k) for k in kept] for _, kept, _, _ in found] == [[699_994, 0], [700_000, 0]]
    assert [size for _, _, size, _ in found] == [[700_000, 0], [700_000, 10]] and [parts for *_, parts in found] == [[2, 0], [0, 1]]
