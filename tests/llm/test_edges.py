"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import zlib

import numpy as np
import pytest
from oracle import DATA, same
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import bag_minhash, decontamination, kneser_ney, language_id, license_scan, quality_rules, registry, sentencepiece_sampling, suffix_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat and the dog of the house were in the garden with the other cats of the town."
DE = "der hund und die katze sind in dem garten mit den anderen katzen der stadt und des landes."
LONG = " ".join(f"word{i}" for i in range(9000)) + "."
ROWS = [
    (1, EN, "en", "a", 1), (2, DE, "de", "a", 1), (3, None, "en", "a", None), (4, "", None, None, 0), (None, EN + " more", "en", "b", 1), (5, "12 34 !!", "de", "b", 8),
    (6, EN, "en", "c", 1), (6, EN, "en", "c", 1), (7, LONG, "en", "c", 1), (8, LONG + " tail", "en", "c", 1), (9, "Licensed under the MIT License\nok ok", "en", "a", 1), (10, "ü", "de", "a", 1),
]


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    clash = {"lang_pred": F.lit("x"), "piece_ids": F.lit(7), "toxic": F.lit(9), "host": F.lit("h"), "Verdict": F.lit("v"), "rule": F.lit("r"), "license": F.lit("l"), "score": F.lit(2.0), "class_id": F.lit(-1), "tid": F.lit(3), "key": F.lit("k"), "h": F.lit(0), "c0": F.lit("c"), "item_id": F.lit(5), "n": F.lit(1)}
    more = lambda df: df.withColumns({k: v for k, v in clash.items() if k not in df.columns})
    more(spark.createDataFrame(ROWS, DOCS)).write.parquet(f"{d}/documents.parquet")
    more(spark.createDataFrame([(1, "http://EXAMPLE.org/es/x?q"), (2, None), (3, "no scheme"), (4, "https://a.b.example.org/en/12#t"), (5, "https://x.com"), (6, "x://y.com/de/1"), (6, "x://y.com/de/1"), (None, "http://org/")], "page_id long, url string")).write.parquet(f"{d}/pages.parquet")
    more(spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, 1), (6, 0, 0), (None, 1, 1), (99, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))).write.parquet(f"{d}/labels.parquet")
    more(spark.createDataFrame([(1, "the other cats of the town and the village"), (2, None), (3, "")], "item_id long, text string").withColumn("doc_id", F.lit("d"))).write.parquet(f"{d}/benchmark.parquet")
    e = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "pages", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{e}/{name}.parquet")
    return d, e


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_edges_and_empty(spark, lake, name):
    full, empty = (registry.QUERIES[name](spark, d) for d in lake)
    rows = full.collect()
    assert full.schema == empty.schema and empty.count() == 0
    if name == "op2_url_filter":
        assert len(rows) == 8
    elif name != "op7_decontamination":
        assert sorted((r.doc_id or 0) for r in rows) == sorted((r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_oracle(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], DATA)


def test_pipeline(spark, lake):
    rows = corpus_pipeline.run(spark, lake[0]).collect()
    ids = [r.doc_id for r in rows]
    assert {3, 4, 5}.isdisjoint(ids) and len(ids) == len(set(ids)) and ids.count(1) == 1 and 6 not in ids
    extra = ["lang_pred", "toxic", "host", "Verdict", "rule", "license", "score", "class_id", "tid", "key", "h", "c0", "item_id", "n"]
    assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars", *extra, "piece_ids"]
    assert {(r.lang_pred, r.toxic, r.tid) for r in rows} == {("x", 9, 3)} and all(isinstance(r.piece_ids, list) for r in rows)
    assert corpus_pipeline.run(spark, lake[1]).count() == 0


def test_url_rules(spark, lake):
    got = {(r.page_id, r.rule, r.verdict, r.host, r.path) for r in url_filter.op2_url_filter(spark, lake[0]).collect()}
    assert (1, "example.org/es/", "block", "example.org", "/es/x") in got and (4, "example.org/en/1", "block", "a.b.example.org", "/en/12") in got
    assert (5, None, "allow", "x.com", "") in got and (2, None, "allow", "", "") in got and (6, "com/de/", "block", "y.com", "/de/1") in got and (None, "org/", "allow", "org", "/") in got


def test_url_nested_rules_and_salts(spark):
    rules = spark.createDataFrame([("a.b", "/", "allow"), ("a.b", "/x", "block"), ("a.b", "/x/y/", "allow"), ("b", "/x/y/z", "block"), ("a.b", "/x", "allow")], "host string, path string, verdict string")
    urls = [(f"http://{h}/{p}",) for h in ("a.b", "c.a.b", "b", "xa.b") for p in ("", "x", "xx", "x/y/", "x/y/z", "w", "x/y")]
    pages = spark.createDataFrame(urls, "url string").withColumn("host", F.lit("clash"))
    found = url_filter.host_and_path(F.col("url"))
    points = pages.select(found[0].alias("host"), found[1].alias("path"))
    for target in (1_000_000, 2):
        got = {(r.host, r.path): r.rule for r in url_filter.judged(points, rules, target).collect()}
        for (u,) in urls:
            h, p = u[7:].split("/", 1)
            fits = [a + b for a, b, _ in rules.collect() if (h == a or h.endswith("." + a)) and ("/" + p).startswith(b)]
            assert got.get((h, "/" + p)) == (max(fits, key=len) if fits else None)
    assert url_filter.filtered(pages, rules).where("host = 'clash'").count() == 0


def test_language(spark, lake):
    got = {r.doc_id: r for r in language_id.op3_language_id(spark, lake[0]).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0
    assert got[1].held_out == (zlib.crc32(b"1") % 4 == 2) and 0 <= got[10].score <= 1
    model = language_id.fitted([("en", 0, "the", 3), ("de", 0, "der", 3), ("en", 2, "th", 3), ("de", 2, "de", 3), ("en", 1, "t", 1), ("de", 1, "d", 1)], {"en": 1, "de": 1})
    scores = language_id.Scores(model)
    assert language_id.predict(scores, "The")[0] == "en" and language_id.predict(scores, "xdey")[0] == "de" and language_id.predict(scores, "ttt")[0] == "en"
    assert language_id.predict(scores, "日本")[0] == "de" and language_id.predict(scores, None) == ("und", 0.0)


def test_values_of_ties_and_long_texts(spark, lake):
    """Copies have one result each, whatever their doc_id; long texts are judged as a whole."""
    for name, columns in (("op8_toxicity", ("score", "predicted")), ("op3_language_id", ("lang_pred", "score")), ("op10_quality_rules", ("n_words", "kept")), ("op5_suffix_dedup", ("n_bytes", "n_removed", "kept_sha256"))):
        got = {}
        for r in registry.QUERIES[name](spark, lake[0]).collect():
            got.setdefault(r.doc_id, set()).add(tuple(r[c] for c in columns))
        assert got[1] == got[6] and len(got[6]) == 1, name
    words = {r.doc_id: r.n_words for r in registry.QUERIES["op10_quality_rules"](spark, lake[0]).collect()}
    assert words[7] == 9000 and words[8] == 9001
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.op5_suffix_dedup(spark, lake[0]).collect()}
    assert removed[7] == (len(LONG), len(LONG)) and removed[8] == (len(LONG) + 5, len(LONG))
    long = spark.createDataFrame([(1, f"{LONG} the other cats of the town and the village {LONG}"), (2, LONG)], "doc_id long, text string")
    found = decontamination.found_leaks(long, spark.read.parquet(f"{lake[0]}/benchmark.parquet")).collect()
    assert [(r.doc_id, r.item_id, r.start) for r in found] == [(1, 1, len(LONG) + 1)]


def test_language_accuracy(spark):
    done = language_id.op3_language_id(spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    right, n = done.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right > 0.95


def test_license(spark):
    rows = [("r/LICENSE", "Released under the MIT License"), ("r/a/b/x.py", "code"), ("r/a/LICENSE.md", "Licensed under the Apache License, Version 2.0"), ("r/a/b/c/y.py", "z"), ("q/y.py", "z"), (None, "z"), ("r/z.py", "# Licensed under CC BY-NC 4.0.\nx"), ("q/LICENSE", None)]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("clash"))
    got = {r.path: (r.license, r.source_kind, r.license_dir) for r in license_scan.scanned(files, license_scan.templates(spark)).collect()}
    assert got == {
        "r/LICENSE": ("mit", "own", None), "r/a/b/x.py": ("apache-2.0", "inherited", "r/a"), "r/a/LICENSE.md": ("apache-2.0", "own", None), "r/a/b/c/y.py": ("apache-2.0", "inherited", "r/a"),
        "q/y.py": (None, "none", None), None: (None, "none", None), "r/z.py": ("cc-by-nc-4.0", "own", None), "q/LICENSE": (None, "none", None),
    }


def test_pieces_follow_the_lattice():
    vocabulary = ["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a", "<x>"]
    p = sentencepiece_sampling.Pieces(vocabulary, [False] + [True] * 7 + [False], [8] * 256)
    n = 20000
    ids = sentencepiece_sampling.encode(p, ["abab aba"] * n, np.arange(n, dtype=np.uint64))

    def ways(s):
        return [(vocabulary.index(s[:i]), *rest) for i in range(1, len(s) + 1) if s[:i] in vocabulary for rest in ways(s[i:])] if s else [()]

    weight = {a + b: np.exp(sum(p.log_weight[i] for i in a + b)) for a in ways("abab") for b in ways("▁aba")}
    total = sum(weight.values())
    seen = {}
    for x in ids:
        seen[tuple(x.tolist())] = seen.get(tuple(x.tolist()), 0) + 1
    assert set(seen) <= set(weight) and max(abs(seen.get(k, 0) / n - w / total) for k, w in weight.items()) < 0.015


def test_pieces_round_trip(spark):
    texts = ["a▁b  \n\n x", "", None, "日本語 😀 é\x00", "   ", "x" * 3000, "\n", "ends with space "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = sentencepiece_sampling.encoded(docs)
    back = {r.doc_id: (r.decoded, r.piece_ids) for r in sentencepiece_sampling.decoded(made).collect()}
    assert [back[i][0] for i in range(len(texts))] == texts and back[2][1] is None and back[1][1] == []
    again = {r.doc_id: r.piece_ids for r in sentencepiece_sampling.encoded(docs.repartition(3)).collect()}
    assert all(again[i] == back[i][1] for i in back)


def test_decontamination_bounds():
    rng = np.random.default_rng(4)
    letters = "abcdefghij klmnop"
    text = lambda n: "".join(letters[i] for i in rng.integers(0, len(letters), n)).strip()
    items = [decontamination.normal(text(160)) for _ in range(12)]
    index = decontamination.Index(list(enumerate(items)), 10, 0.08)
    for j, item in enumerate(items):
        k = int(index.edits[j])
        for edits in (0, k, 3 * k):
            chars = list(item)
            for at in np.linspace(2, len(chars) - 3, edits).astype(int):
                chars[at] = "z"
            doc = decontamination.normal(text(300) + " " + "".join(chars) + " " + text(200))
            codes = decontamination.codes_of(doc)
            hits = [h for h in index.leaks(doc, codes, list(index.regions(codes))) if h[0] == j]
            assert bool(hits) == (edits <= k), (j, edits)


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        item, text = ("".join("abc"[i] for i in rng.integers(0, 3, n)) for n in (12, 30))
        want = edit_distance_in(item, text)
        got = decontamination.align(decontamination.codes_of(item), decontamination.codes_of(text), -12, 30, 12)
        assert got is not None and got[0] == want
        assert edit_distance_in(item, text[got[1] : got[2]]) == want


def test_toxicity_learns():
    rng = np.random.default_rng(2)
    words = ["".join("aeioulmnrst"[i] for i in rng.integers(0, 11, 5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(300):
        own = [words[j] for j in rng.integers(0, 300, 60)]
        if i % 3 == 0:
            own[10], own[11] = "horrible", "dreadful"
        texts.append(" ".join(own))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts[:210], labels[:210])
    known = toxicity.WordScores(model)
    found = [toxicity.score(known, model.bias, t) >= 0.5 for t in texts[210:]]
    assert np.mean(np.array(found) == np.array(labels[210:], bool)) > 0.95
    assert known["horribel"] > np.median([known[w] for w in words]) + 5
    flat = toxicity.fit(["x"], [0])
    assert toxicity.score(toxicity.WordScores(flat), flat.bias, None) < 1e-6


def kneser_ney_brute(train, grams):
    """Direct recursion over dictionaries of 5-grams given as tuples."""
    counts = {5: {}}
    for g in train:
        counts[5][g] = counts[5].get(g, 0) + 1
    for k in (4, 3, 2, 1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    size = len({g[-1] for g in grams}) + 1
    d = {k: kneser_ney.discounts([sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4)]) for k in counts}

    def p(g):
        k = len(g)
        if not k:
            return 1 / size
        own = {h: c for h, c in counts[k].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        cut = lambda c: d[k][min(c, 3) - 1]
        c = own.get(g, 0)
        return ((c - cut(c) if c else 0) + sum(map(cut, own.values())) * p(g[1:])) / sum(own.values())

    return {g: p(g) for g in grams}


def test_kneser_ney(spark):
    good, other = ["abab abba aab", "ba ab abab bb", "aabb ab ab"], ["abc ab", "zzz", "ab ab"]
    docs = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in other], "text string, trusted boolean")
    made = kneser_ney.counted(docs)
    got = {r.gram: r.p for r in kneser_ney.probabilities(made).collect()}
    unpack = lambda g: tuple((int(g) >> s) & 4095 for s in (48, 36, 24, 12, 0))
    train = [unpack(g) for g in kneser_ney.packed(good)[0]]
    every = {unpack(g) for g in kneser_ney.packed(good + other)[0]}
    want = kneser_ney_brute(train, every)
    assert len(got) == len(want)
    for g, p in got.items():
        assert p == pytest.approx(want[unpack(g)], rel=1e-9)


def test_perplexity_paths_agree(spark, lake):
    docs = spark.read.parquet(f"{lake[0]}/documents.parquet").select("doc_id", "lang", "text")
    ids = kneser_ney.trusted_ids(spark.read.parquet(f"{lake[0]}/labels.parquet"))
    assert {r.doc_id for r in ids.collect()} == {1, 2}
    a, b = (sorted(((r.doc_id or 0, r.n_chars, r.perplexity, r.kept) for r in kneser_ney.classified(docs, ids, broadcast_grams=n).collect()), key=repr) for n in (10**6, 0))
    assert a == b


def test_perplexity_by_blocks(spark):
    """Many small blocks, texts longer than one, repeated rows, other scripts, nulls and empty texts."""
    texts = [EN, DE, None, "", LONG, "日本語の文章", EN, *(f"{EN} {i % 7} {'x' * (i % 50)}" for i in range(200))]
    docs = spark.createDataFrame([(t, i, "en", i % 2 == 0) for i, t in enumerate(texts)], "text string, doc_id long, lang string, trusted boolean").repartition(3)
    p = kneser_ney.probabilities(kneser_ney.counted(docs.select("text", "trusted"))).selectExpr("gram", "high", "cast(round(ln(p) * 1000) as long) log_p")
    want = kneser_ney._scored_by_broadcast(docs, p).collect()
    assert len(want) == len(texts)
    for size in (1, 500, 1 << 26):
        assert sorted(kneser_ney._scored_by_blocks(docs, p, size).collect(), key=lambda r: r.doc_id) == sorted(want, key=lambda r: r.doc_id)
    assert {r.n for r in kneser_ney.blocked(docs, 500).groupBy("block").agg(F.count("*").alias("n")).collect()} > {1}


def test_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 62, 60, dtype=np.int64).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    same_ = []
    for r in range(30):
        hr = h + np.uint64(r * 1000003)
        sig = bag_minhash.signatures(np.concatenate([hr, hr]), np.repeat([0, 1], 60), np.concatenate([a, b]), 2)
        same_.append((sig[0] == sig[1]).mean())
    assert np.mean(same_) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_near_classes(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 500, 400)]
    rows = []
    for i in range(60):
        own = list(base)
        for at in rng.integers(0, 400, 3 + i % 9):
            own[at] = f"x{i}{at}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"u{j}" for j in rng.integers(0, 10**6, 50))) for i in range(5)] + [(200, rows[3][1]), (201, None), (202, " "), (None, rows[3][1]), (203, "one two"), (204, "One two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from collections import Counter

    def bag(t):
        w = (t or "").lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), set()).add(d)
    found, members = bag_minhash.classes(docs)
    got = {}
    for r in members.join(found, "tid", "left").collect():
        got.setdefault(r.root if r.root is not None else ("alone", r.doc_id), set()).add(r.doc_id)
    assert sorted(map(sorted, ([x or 0 for x in g] for g in got.values()))) == sorted(map(sorted, ([x or 0 for x in g] for g in groups.values())))
    kept = [r.doc_id for r in bag_minhash.near_dedup(docs).collect()]
    assert len(kept) == len(groups) and 201 in kept and 202 in kept


def test_quality_lines():
    text = "A fine sentence of words.\nHome | About | Contact\nBUY!! NOW!! HERE!!\nAll rights reserved by us.\nmenu item\nA fine sentence of words.\n"
    clean, repeated, gone, lost, total = quality_rules.clean(text.encode())
    assert clean == b"A fine sentence of words.\nA fine sentence of words.\n" and (repeated, gone, lost, total) == (1, 4, 15, 25)


def test_cleaned_text_stays_utf8(spark):
    texts = ["é" * 150, "xé" + "é" * 150, None, "ok"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.cleaned(docs).collect()}
    assert got == {0: "", 1: "x", 2: None, 3: "ok"}


@pytest.mark.parametrize("per_task,most", [(1 << 17, 1), (1, 7)])
def test_components_rounds_write_files_by_their_links(spark, monkeypatch, per_task, most):
    from siftline.llm import common

    files = []

    def cut(df, real=common.cut):
        files.append((done := real(df)).rdd.getNumPartitions())
        return done

    monkeypatch.setattr(common, "cut", cut)
    monkeypatch.setattr(common, "LINKS", per_task)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 105)]
        got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 105: 100}
    assert len(files) > 3 and max(files[1:]) == most
