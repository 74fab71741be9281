"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next.

1. Language ID: documents without a language (no letter, a score below MIN_SCORE, or evidence in less than MIN_KNOWN of the words, whatever the languages' shares) go; lang becomes what was found.
2. MinHash near-dedup: one document of each near-duplicate class stays.
3. Suffix-array dedup: bytes that repeat in 200-byte strings go from the text; n_chars follows; bytes of a character that was cut apart go with it.
4. Benchmark decontamination: documents with a benchmark passage go.
5. SentencePiece: sampled piece ids are added.

Defined cases: extra columns of documents are carried, whatever they are called, but one named piece_ids is replaced by the last stage; a null or letterless text has no language and goes;
repeated rows are near-duplicates of each other; a null doc_id is a row like others, kept last of its class; very long texts are whole; an empty table gives an empty result. A stage's tables are
deleted once its output is written; that of the last but one stage stays for the result, which reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bag_minhash, decontamination, language_id, sentencepiece_sampling, suffix_dedup
from siftline.llm.common import MADE, drop_made, table, written

MIN_SCORE = MIN_KNOWN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    by_place = docs.toDF(*(f"c{i}" for i in range(len(names))))  # whatever columns are called, none is taken for a prediction
    doc_id, text, lang = (f"c{names.index(n)}" for n in ("doc_id", "text", "lang"))
    found = language_id.identified(by_place, language_id.train(by_place, lang, text, doc_id), text)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= MIN_SCORE) & (F.col("lang_known") >= MIN_KNOWN))
    return kept.withColumn(lang, F.col("lang_pred")).select(*by_place.columns).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bag_minhash.near_dedup(docs)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = suffix_dedup.cleaned(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else done


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_array),
    ("decontamination", decontaminate),
    ("sentencepiece", pieces),
]

#: The stages learn, sample and align; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = len(MADE)
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
            drop_made(spark, MADE[max(0, before - (i > 0)) : -1])
    return docs
