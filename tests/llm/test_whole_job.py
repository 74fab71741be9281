"""Cases in which an operator once did less than its whole job."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from oracle import DATA
from pyspark.sql import functions as F

from siftline.llm import bag_minhash, decontamination, kneser_ney, language_id, license_scan, registry, toxicity, url_filter


def test_signature_does_not_depend_on_the_slice():
    rng = np.random.default_rng(11)
    h = rng.integers(1, 1 << 62, (1500, 10), dtype=np.int64).astype(np.uint64)
    full = bag_minhash.signatures(h.ravel(), np.repeat(np.arange(1500), 10), np.ones(15000, int), 1500)
    for i in range(0, 1500, 50):
        alone = bag_minhash.signatures(h[i], np.zeros(10, int), np.ones(10, int), 1)
        assert (alone[0] == full[i]).all(), i


def test_licence_beside_rare_words(spark):
    want = {
        "a.py": ("Copyright c 2024 Jane Doe\nReleased under the MIT License.", "mit"),
        "b.py": ("Frobnicator zyzzyva quux licence notes of Wolpertinger\nLicensed under the Apache License, Version 2.0", "apache-2.0"),
        "c.py": ("The frobnicator by Wolpertinger and Zyzzyva, released under the MIT License since grault garply waldo fred plugh", "mit"),
        "d.py": ("Wolpertinger has a driving licence of quux garply and waldo", None),
    }
    plain = [f"Released under the MIT License{' ' * (i % 3)}" for i in range(300)] + ["All rights reserved."] * 80
    rows = [(k, v[0]) for k, v in want.items()] + [(f"p/{i}.py", t) for i, t in enumerate(plain)]
    for n in (4, 40, len(rows)):  # what is found does not depend on the corpus's size
        files = spark.createDataFrame(rows[:n], "path string, text string")
        got = {r.path: r.license for r in license_scan.scanned(files, license_scan.templates(spark)).collect()}
        assert {k: got[k] for k in want} == {k: v[1] for k, v in want.items()}, n


@pytest.mark.parametrize("broadcast_grams", [10**6, 0])
def test_perplexity_tells_letters_of_every_script_apart(spark, broadcast_grams):
    good = ["今天天气很好我们去公园散步", "今天天气很好他们去公园吃饭"]
    rows = [(i, "zh", good[i % 2]) for i in range(20)] + [(100, "zh", "饭天园吃很去散公气好们他步"), (101, "zh", "\U0001f600€“龘靐齉爩鱻麤" * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    ids = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = {r.doc_id: r for r in kneser_ney.classified(docs, ids, broadcast_grams=broadcast_grams).collect()}
    assert got[0].kept and got[0].n_chars == 13 and max(got[0].perplexity, got[1].perplexity) * 3 < min(got[100].perplexity, got[101].perplexity)
    assert not got[100].kept and not got[101].kept
    low, _, high = kneser_ney.packed(["".join(map(chr, range(0x2000, 0x9000)))])
    assert len({*zip(low.tolist(), high.tolist(), strict=True)}) == 0x7001


def test_language_stage_rejects_an_unlearned_script(spark):
    en, de = "the cat and the dog of the house were in the garden", "der hund und die katze sind in dem garten"
    rows = [(i, en, "en", "a", 1) for i in range(8)] + [(10 + i, de, "de", "a", 1) for i in range(2)]
    rows += [(20, "今天天气很好 我们去公园散步", None, "a", 1), (21, "сегодня хорошая погода мы идем гулять", None, "a", 1), (22, "the dogs of the gardens", None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {i: "en" for i in [*range(8), 22]} | {10: "de", 11: "de"}


def test_full_licence_texts(spark):
    """Files of whole licences, with a copyright line and other line ends than the templates."""
    texts = dict(license_scan.TEXTS)
    owner = "Copyright (c) 2031 Wolpertinger and Zyzzyva\n\n"
    wrap = lambda t: re.sub(r"(.{30,70}) ", r"\1\n", t)
    rows = [(f"{n}/LICENSE", owner + wrap(t)) for n, t in texts.items()] + [(f"{n}/src/a.py", "x = 1") for n in texts]
    rows += [("mit/sub/LICENSE.txt", wrap(texts["bsd-3-clause"])), ("mit/sub/b.py", ""), ("none/LICENSE", "You may not do anything with it."), ("none/c.py", None)]
    got = {r.path: (r.license, r.source_kind) for r in license_scan.scanned(spark.createDataFrame(rows, "path string, text string"), license_scan.templates(spark)).collect()}
    assert {"mit", "bsd-3-clause", "apache-2.0", "gpl-3.0", "gpl-2.0"} <= set(texts)
    for n in texts:
        assert got[f"{n}/LICENSE"] == (n, "own") and got[f"{n}/src/a.py"] == (n, "inherited"), n
    assert got["mit/sub/b.py"] == ("bsd-3-clause", "inherited") and got["none/LICENSE"] == got["none/c.py"] == (None, "none")


def test_licence_scan_reads_text_once_in_the_jvm(spark):
    df = registry.QUERIES["op4_license_scan"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "Python" not in plan and "Arrow" not in plan  # headers and paths were written by one scan


def test_url_filter_has_no_python(spark):
    plan = registry.QUERIES["op2_url_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_rules_of_many_depths(spark):
    hosts = ["org", "a.org", "b.a.org", "c.b.a.org", "com", "x.com", "com.org", "ab.org"]
    rules = [(h, p, "block" if i % 2 else "allow") for i, h in enumerate(hosts[:6]) for p in ("/", "/d", "/d/e")]
    urls = [(f"{s}{h}", p) for h in hosts for s in ("", "www.", "b.", "q.r.") for p in ("", "/", "/d", "/dd", "/d/e/f", "/x")]
    points = spark.createDataFrame(urls, "host string, path string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for target in (10**6, 5):
        got = {(r.host, r.path): (r.rule, r.verdict) for r in url_filter.judged(points, table, target).collect()}
        for h, p in urls:
            fits = [(len(a + b), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
            assert got.get((h, p)) == (max(fits)[1:] if fits else None), (h, p)
    assert url_filter.judged(points, table.limit(0)).count() == 0


def _bag(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def test_near_classes_of_the_given_documents(spark):
    """Classes are those of brute force over every pair of texts that share a shingle; a link that LSH could miss would show here."""
    path = DATA.replace("sf0.001", "sf0.01")
    rows = [(r.doc_id, _bag(r.text)) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    holders = {}
    for i, (_, bag) in enumerate(rows):
        for x in bag:
            holders.setdefault(x, []).append(i)
    size = [sum(b.values()) for _, b in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, bag) in enumerate(rows):
        both = Counter()
        for x, n in bag.items():
            for j in holders[x]:
                if j < i:
                    both[j] += min(n, rows[j][1][x])
        for j, n in both.items():
            if n >= 0.8 * (size[i] + size[j] - n) - 1e-9:
                parent[find(i)] = find(j)
    want = {}
    for i, (d, bag) in enumerate(rows):
        want.setdefault(find(i) if bag else ("none", d), set()).add(d)
    got = {}
    for r in bag_minhash.op9_bag_minhash(spark, path).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pages_of_one_template_fall_apart(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        own = list(base)
        at = int(rng.integers(0, 140))
        own[at : at + 65] = [f"u{i}x{j}" for j in range(65)]
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, rows[i][1] + " tail words here") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bag_minhash.classes(docs)[0].groupBy("class_id").agg(F.max("class_docs").alias("n")).collect()
    assert Counter(r.n for r in got) == {1: 595, 2: 5}
    tids = bag_minhash.identified(docs).select(F.col("__tid").alias("tid"), F.lit(1).cast("long").alias("area"), F.col("__tid").alias("comp"))
    bags = bag_minhash.signed(bag_minhash.identified(docs).select(F.col("__tid").alias("tid"), "text")).select("tid", "n", "bag")
    kept = bag_minhash.refined(tids, bags)  # all in one area: only the pairs that share rare shingles stay together
    assert kept.count() == 10 and kept.select("area").distinct().count() == 5


def test_language_by_brute_force(spark):
    """The same sums from the model's tables, word by word."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out()))
    counts = {n: {g: model.logs[n][i] for g, i in rows.items()} for n, rows in model.rows.items()}

    def score(word):
        if word in counts[0]:
            return counts[0][word]
        for n in (4, 3, 2, 1):
            found = [counts[n][g] for g in language_id.grams(word, n) if g in counts.get(n, {})]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(model.langs))

    for r in language_id.identified(docs.withColumn("lang_pred", F.lit("clash")), model).collect():
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if not words:
            assert (r.lang_pred, r.lang_score) == ("und", 0)
            continue
        z = sum(map(score, words)) + model.prior
        assert r.lang_pred == model.langs[int(np.argmax(z))]
        z = (z - z.max()) * min(len(words), language_id.EVIDENCE) / len(words)
        assert r.lang_score == pytest.approx(1 / np.exp(z).sum(), rel=1e-6)


def test_language_sample_is_bounded_by_keys(spark):
    rows = [(7, "en", "the cat")] * 500 + [(i, "de", "der hund und") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(docs)
    assert "the" not in model.rows.get(0, {}) and "hund" in model.rows[0] and model.langs == ["de", "en"]  # a repeated key counts once
    assert np.exp(model.prior) == pytest.approx([40 / 540, 500 / 540])


def test_toxicity_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 2, toxicity.BUCKETS), -0.7)
    for r in toxicity.scored(docs.withColumn("TOXIC_SCORE", F.lit(1)), model).collect():
        every = re.findall(r"[^\W_]+", (r.text or "").lower())
        words = [w for i, w in enumerate(every) if not i or every[i - 1] != w]
        parts = [words[i : i + toxicity.PASSAGE] for i in range(0, len(words), toxicity.PASSAGE)]
        if len(parts) > 1 and len(parts[-1]) < toxicity.PASSAGE // 2:
            parts[-2:] = [parts[-2] + parts[-1]]
        each = [np.mean([np.mean([model.grams[f] for f in toxicity.features(w)]) for w in p]) for p in parts]
        assert r.toxic_score == pytest.approx(1 / (1 + np.exp(-(max(each, default=0) + model.bias))), rel=1e-6)


def test_leaks_keep_repeated_rows(spark):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix strong potions"
    docs = spark.createDataFrame([(1, f"intro {passage} end")] * 3 + [(2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(5, passage), (5, passage)], "item_id long, text string")
    rows = decontamination.found_leaks(docs, items).collect()
    assert len(rows) == 6 and {(r.doc_id, r.item_id, r.edits) for r in rows} == {(1, 5, 0)}
    assert [r.doc_id for r in decontamination.without_leaks(docs, items).collect()] == [2]


def test_leaks_by_brute_force(spark):
    """The query's whole path against alignment of every item with every text."""
    rng = np.random.default_rng(12)
    word = lambda: "".join("abcdefghij"[i] for i in rng.integers(0, 10, rng.integers(2, 8)))
    items = [" ".join(word() for _ in range(12)) for _ in range(6)]
    docs = []
    for i in range(60):
        text = [" ".join(word() for _ in range(30)), " ".join(word() for _ in range(30))]
        if i % 3:
            item = list(items[i % 6])
            for at in rng.integers(0, len(item), i % 9):
                item[at] = "z"
            text.insert(1, "".join(item))
        docs.append((i, " \n".join(text)))
    found = decontamination.found_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.edits for r in found.collect()}
    want = {}
    for d, text in docs:
        for j, item in enumerate(items):
            a, b = decontamination.normal(item), decontamination.normal(text)
            row = np.zeros(len(b) + 1, int)
            for i, c in enumerate(a, 1):
                best = np.minimum(row[:-1] + np.array([x != c for x in b]), row[1:] + 1)
                new = np.empty(len(b) + 1, int)
                new[0] = i
                for k in range(len(b)):
                    new[k + 1] = min(best[k], new[k] + 1)
                row = new
            if row.min() <= decontamination.budget(len(a)):
                want[d, j] = int(row.min())
    assert got == want and len(want) > 10


def test_toxicity_on_held_out_documents(spark):
    """Learned from the other documents' labels alone. Some labelled texts hold no toxic word at all, so recall has a ceiling below 1."""
    path = DATA.replace("sf0.001", "sf0.1")
    done = toxicity.op8_toxicity(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    hit, said, toxic = done.select(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert hit / toxic >= 0.65 and hit / said >= 0.8, (hit, said, toxic)
