"""Licence scans in DataFrame operations: TF-IDF cosine to templates, then inheritance from the nearest directory.

The header of a file named LICENSE (or so) is its whole text, that of another file its lines that speak of licences. Templates are one-sentence statements and the full texts
in licenses/. Equal headers are scored once: a term weighs (1 + ln(times)) x (ln((1 + N) / (1 + df)) + 1), with document frequencies over all files that have a header and over
the templates, and is joined with the templates' terms; a header has the template of highest cosine if that is THRESHOLD or more. A header that reaches it as a whole with none is
scored again in pieces, so that neither words beside a statement nor the corpus's size hide it: each line and sentence
of it by THRESHOLD, and each span of as many words as a template (in one line, with half of its words at least) with that template by SPAN_THRESHOLD. A licence file gives its licence to its directory. A
file without one of its own inherits from the nearest directory above it that has one: every distinct directory is joined
with its ancestors.

Scale: one scan reads text, and writes paths and headers with a 128-bit key; what is shuffled after it are keys, terms of distinct headers,
and paths. Every join is an equi-join that adaptive execution can split. The templates are a fixed table; nothing else is broadcast by hand.

Defined cases: null and empty texts have no header; a null path has no directory and inherits nothing; ties go to the template whose name is first;
several licence files in a directory count as the one of highest cosine, then first name; repeated rows give repeated rows; very long texts are
scanned whole; an empty table gives an empty result; only path and text are read, columns named license, cosine, source_kind and license_dir are replaced and others are carried.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, without, written

THRESHOLD, SPAN_THRESHOLD = 0.5, 0.75
ABOUT = "licen[cs]e|copyright|spdx|permission is hereby|without warranty|redistribution and use|all rights reserved"
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: name, text of the statement that stands in headers.
TEMPLATES = (
    ("agpl-3.0", "This program is free software under the terms of the GNU Affero General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license"),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
)


#: Full texts, by name.
TEXTS = tuple(sorted((p.stem, p.read_text(encoding="utf-8")) for p in (Path(__file__).parent / "licenses").glob("*.txt")))
#: id, text; the licence is the id up to "#". A statement and a full text of one licence are templates of their own.
ALL = TEMPLATES + tuple((f"{name}#text", text) for name, text in TEXTS)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def templates(spark: SparkSession) -> DataFrame:
    """(name, header) as a local relation: built by the JVM, without Python on executors."""
    values = ", ".join(f"({_sql_text(n)}, {_sql_text(t.replace(chr(92), ' '))})" for n, t in ALL)
    return spark.sql(f"SELECT * FROM VALUES {values} AS templates(name, header)")


def header_of(text: str, file: Column) -> Column:
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: line.rlike(f"(?i){ABOUT}"))
    return F.when(file.rlike(LICENCE_FILE), F.when(F.col(text) != "", F.col(text))).when(F.col(text).rlike(f"(?i){ABOUT}"), F.array_join(lines, "\n"))


def terms(df: DataFrame, *keep: str) -> DataFrame:
    """keep columns, term, tf of a header column."""
    return df.select(*keep, F.explode(F.regexp_extract_all(F.lower("header"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).groupBy(*keep, "term").agg(F.count("*").alias("tf"))


def pieces(headers: DataFrame, known: DataFrame) -> DataFrame:
    """(key, piece, only): lines and sentences (only is '') and spans of a template's length (only is its name)."""
    lines = headers.select("key", F.explode(F.split("header", "\n")).alias("line"))
    sentences = lines.select("key", F.explode(F.concat(F.array("line"), F.split("line", r"(?<=[.;!?])\s+"))).alias("piece"), F.lit("").alias("only"))
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    wanted = F.broadcast(known.select("name", tokens("header").alias("own")))
    pairs = lines.select("key", tokens("line").alias("said")).join(wanted, F.size("said") >= F.size("own"))
    enough = lambda span: F.size(F.array_intersect(span, F.col("own"))) * 2 >= F.size(F.array_distinct("own"))
    spans = F.transform(F.sequence(F.lit(1), F.size("said") - F.size("own") + 1), lambda i: F.slice("said", i, F.size("own")))
    cut_out = pairs.where(enough(F.col("said"))).select("key", F.explode(F.filter(spans, enough)).alias("span"), "name")
    return sentences.unionByName(cut_out.select("key", F.array_join("span", " ").alias("piece"), F.col("name").alias("only"))).distinct()


def matched(headers: DataFrame, known: DataFrame) -> DataFrame:
    """(key, name, cosine): the best template of each distinct header, if good enough. headers: key and header of every file that has one."""
    distinct = written(headers.groupBy("key").agg(F.any_value("header").alias("header"), F.count("*").alias("files")), "license-headers")
    count = distinct.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("total"))
    own, theirs = terms(distinct, "key", "files"), terms(known, "name")
    idf = own.select("term", "files").unionByName(theirs.select("term", F.lit(1).cast("long").alias("files"))).groupBy("term").agg(F.sum("files").alias("df"))
    idf = cut(idf.join(F.broadcast(count)).select("term", (F.log((F.lit(1.0 + len(ALL)) + F.col("total")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")))
    weight = (1 + F.log("tf")) * F.col("idf")
    right = theirs.join(idf, "term").select("name", "term", weight.alias("v"))
    right_norm = right.groupBy("name").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("vn"))

    def scored(found: DataFrame, *by: str) -> DataFrame:
        left = found.join(idf, "term").select(*by, "term", weight.alias("w"))
        left_norm = left.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("wn"))
        dot = left.join(F.broadcast(right), "term").groupBy(*by, "name").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        return dot.join(left_norm, list(by)).join(F.broadcast(right_norm), "name").withColumn("cosine", F.round(F.col("dot") / (F.col("wn") * F.col("vn")), 6))

    def top(scores: DataFrame) -> DataFrame:
        best = scores.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "name")).alias("best"))
        return best.select("key", F.substring_index("best.name", "#", 1).alias("name"), (-F.col("best.c")).alias("cosine"))

    whole = written(top(scored(own, "key").where(F.col("cosine") >= THRESHOLD)), "license-whole")
    parts = cut(pieces(distinct.join(whole, "key", "left_anti"), known))
    near = scored(terms(parts.select("piece", "only").distinct().withColumn("header", F.col("piece")), "piece", "only"), "piece", "only")
    good = near.where(F.when(F.col("only") == "", F.col("cosine") >= THRESHOLD).otherwise((F.col("only") == F.col("name")) & (F.col("cosine") >= SPAN_THRESHOLD)))
    return cut(whole.unionByName(top(parts.join(good, ["piece", "only"]))))


def directory(path: str) -> Column:
    return F.regexp_extract(F.col(path), "^(.*)/[^/]*$", 1)


def scanned(files: DataFrame, known: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """files without text, with license, cosine (of an own header), source_kind ('own', 'inherited' or 'none') and license_dir (inherited from)."""
    files = without(files, "license", "cosine", "source_kind", "license_dir", "__header", "__key", "__dir", "__file")
    names = [c for c in files.columns if c != text]
    kept = [F.col(f"`{c}`") for c in names]
    file = F.element_at(F.split(F.col(path), "/"), -1)
    read = files.select(*kept, header_of(text, file).alias("__header"), directory(path).alias("__dir"), file.alias("__file"))
    # A file without a header has a key of its own, so that such files match nothing, but not in one task.
    key = F.unhex(F.md5(F.coalesce(F.col("__header"), F.concat(F.lit("\0"), F.col(path)), F.lit("\0"))))
    own = written(read.withColumn("__key", key), "license-files")
    best = matched(own.where("__header IS NOT NULL").select(F.col("__key").alias("key"), F.col("__header").alias("header")), known).toDF("__key", "__name", "__cosine")
    rows = own.drop("__header").join(best, "__key", "left")
    given = rows.where(F.col("__file").rlike(LICENCE_FILE) & F.col("__name").isNotNull()).groupBy("__dir").agg(F.min(F.struct((-F.col("__cosine")).alias("c"), F.col("__name").alias("name"))).alias("g")).select(F.col("__dir").alias("up"), F.col("g.name").alias("given"))
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    chain = own.where("__dir IS NOT NULL").select("__dir").distinct().select("__dir", F.explode(above).alias("up"))
    near = cut(chain.join(given, "up").groupBy("__dir").agg(F.max_by(F.struct("given", "up"), F.char_length("up")).alias("__near")))
    done = rows.join(near, "__dir", "left")
    kind = F.when(F.col("__name").isNotNull(), "own").when(F.col("__near").isNotNull(), "inherited").otherwise("none")
    return done.select(*kept, F.coalesce("__name", "__near.given").alias("license"), F.col("__cosine").alias("cosine"), kind.alias("source_kind"), F.when(F.col("__name").isNull(), F.col("__near.up")).alias("license_dir"))


#: Documents have no paths: a document lies in source / doc_id div 4096 / doc_id div 64, and is named LICENSE if it has at most 40 words.
MAX_LICENCE_WORDS = 40


def document_path() -> Column:
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    few = F.when(F.col("text").rlike(f"(?i){ABOUT}"), words <= MAX_LICENCE_WORDS)
    name = F.when(few, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return F.concat_ws("/", F.coalesce("source", F.lit("_")), F.expr("doc_id div 4096").cast("string"), F.expr("doc_id div 64").cast("string"), name)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, license, cosine, source_kind, license_dir of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return scanned(docs.select("doc_id", document_path().alias("path"), "text"), templates(spark))


_T = " UNION ALL ".join(f"SELECT {_sql_text(n)} AS name, {_sql_text(t.replace(chr(92), ' '))} AS header" for n, t in ALL)
ORACLE_SQL = rf"""
WITH f0 AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, '_') || '/' || (doc_id // 4096) || '/' || (doc_id // 64) AS dir,
  CASE WHEN regexp_matches(text, '(?i){ABOUT}') AND len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) <= {MAX_LICENCE_WORDS} THEN 'LICENSE' ELSE doc_id || '.txt' END AS file FROM documents),
f AS (SELECT *, CASE WHEN file = 'LICENSE' THEN text WHEN regexp_matches(text, '(?i){ABOUT}') THEN array_to_string(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(?i){ABOUT}')), chr(10)) END AS header FROM f0),
t AS ({_T}),
h AS (SELECT header, count(*) AS files FROM f WHERE header IS NOT NULL GROUP BY header),
tot AS (SELECT coalesce(sum(files), 0) + {len(ALL)} AS total FROM h),
o AS (SELECT header, any_value(files) AS files, term, count(*) AS tf FROM (SELECT header, files, unnest(regexp_extract_all(lower(header), '[a-z0-9]+')) AS term FROM h) GROUP BY header, term),
tt AS (SELECT name, term, count(*) AS tf FROM (SELECT name, unnest(regexp_extract_all(lower(header), '[a-z0-9]+')) AS term FROM t) GROUP BY name, term),
idf AS (SELECT term, ln((1.0 + any_value(total)) / (1.0 + sum(n))) + 1 AS idf FROM (SELECT term, files AS n FROM o UNION ALL SELECT term, 1 FROM tt), tot GROUP BY term),
l AS (SELECT header, term, (1 + ln(tf)) * idf AS w FROM o JOIN idf USING (term)),
r AS (SELECT name, term, (1 + ln(tf)) * idf AS v FROM tt JOIN idf USING (term)),
s AS (SELECT header, name, round(sum(w * v) / (any_value(wn) * any_value(vn)), 6) AS cosine FROM l JOIN r USING (term)
  JOIN (SELECT header, sqrt(sum(w * w)) AS wn FROM l GROUP BY header) USING (header) JOIN (SELECT name, sqrt(sum(v * v)) AS vn FROM r GROUP BY name) USING (name) GROUP BY header, name),
b AS (SELECT header, split_part(name, '#', 1) AS name, cosine FROM (SELECT *, row_number() OVER (PARTITION BY header ORDER BY cosine DESC, name) AS k FROM s WHERE cosine >= {THRESHOLD}) WHERE k = 1),
u AS (SELECT DISTINCT header, unnest(string_split(header, chr(10))) AS piece FROM h WHERE header NOT IN (SELECT header FROM b)),
pl AS (SELECT piece, term, (1 + ln(tf)) * idf AS w FROM (SELECT piece, term, count(*) AS tf FROM (SELECT piece, unnest(regexp_extract_all(lower(piece), '[a-z0-9]+')) AS term FROM (SELECT DISTINCT piece FROM u)) GROUP BY piece, term) JOIN idf USING (term)),
ps AS (SELECT piece, name, round(sum(w * v) / (any_value(wn) * any_value(vn)), 6) AS cosine FROM pl JOIN r USING (term)
  JOIN (SELECT piece, sqrt(sum(w * w)) AS wn FROM pl GROUP BY piece) USING (piece) JOIN (SELECT name, sqrt(sum(v * v)) AS vn FROM r GROUP BY name) USING (name) GROUP BY piece, name),
b2 AS (SELECT header, split_part(name, '#', 1) AS name, cosine FROM (SELECT header, name, cosine, row_number() OVER (PARTITION BY header ORDER BY cosine DESC, name) AS k FROM u JOIN ps USING (piece) WHERE cosine >= {THRESHOLD}) WHERE k = 1),
x AS (SELECT f.*, name, cosine FROM f LEFT JOIN (SELECT * FROM b UNION ALL SELECT * FROM b2) USING (header)),
g AS (SELECT dir AS up, name AS given FROM (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, name) AS k FROM x WHERE file = 'LICENSE' AND name IS NOT NULL) WHERE k = 1),
n AS (SELECT dir, given, up FROM (SELECT d.dir, given, up, row_number() OVER (PARTITION BY d.dir ORDER BY length(up) DESC) AS k FROM (SELECT DISTINCT dir FROM x) d JOIN g ON d.dir = up OR starts_with(d.dir, up || '/')) WHERE k = 1)
SELECT doc_id, dir || '/' || file AS path, coalesce(name, given) AS license, cosine,
  CASE WHEN name IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS source_kind, CASE WHEN name IS NULL THEN up END AS license_dir
FROM x LEFT JOIN n USING (dir)
"""
