"""The results lake: buckets of runs, as tolerant JSON in and Parquet (with JSON export) out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import ids_udf
from ..operators.capture import merged_labels
from ..operators.stats import clean_labels

BUCKETS = ("discard", "waiting_room", "hits")
AUDIT = "search STRING, pages_requested BIGINT, results_seen BIGINT, already_in_memory BIGINT, passed_prefilter BIGINT, throttled BOOLEAN"
# A file of rows is one file with an array, or a folder of that name with JSON lines in parts.
_PART = r"(/part-[^/]*)?$"
_NOT_ADS = rf"((^|/)metadata\.json|_(hits|discard|match_metadata|metadata|decisions|search_audit)\.json){_PART}"


def is_unclassified(path: str | Column) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(rf"\.json{_PART}") & ~path.rlike(_NOT_ADS)


def named(path: str | Column) -> Column:
    """The path of a file of rows without its parts."""
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"/part-[^/]*$", "")


def run_from_input(path: str) -> str:
    """The run folder that an input lies in; fails if it is not under discard."""
    parts = path.split("/")
    if "discard" not in parts[:-1]:
        raise ValueError(f"no run folder in {path}")
    return parts[parts.index("discard") + 1]


def named_path(path: str) -> str:
    return re.sub(r"/part-[^/]*$", "", path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def run_of(path: str | Column) -> Column:
    """The run folder under discard; '' if the path has none."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, "(?:^|/)discard/([^/]+)/", 1)


def files(spark: SparkSession, root: str, glob: str = "{*.json,part-*.txt}") -> DataFrame:
    """(path, body): whole files at any depth, parts of files of rows as well; none if root is missing."""
    if not _exists(spark, root):
        return spark.createDataFrame([], "path string, body string")
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def _list_of(path: str, body: str) -> Column:
    """The text of a file of rows as one JSON array."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    return F.when(F.col(path).rlike(r"/part-[^/]*$"), F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))).otherwise(F.col(body))


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """(value): a JSON file as one variant; a bad file fails."""
    return files(spark, path).select(F.parse_json("body").alias("value"))


def rows_of(source: DataFrame, strict: bool = False) -> DataFrame:
    """(path, pos, row) of (path, body) files of rows: objects as variants, in order. Unreadable files and other rows are left out; strict: they fail."""
    v = F.try_parse_json(_list_of("path", "body"))
    good = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    checked = F.when(good, v).otherwise(F.raise_error(F.concat(F.lit("not an array of objects: "), F.col("path"))).cast("variant")) if strict else F.when(good, v)
    numbered = source.withColumn("__v", checked).where("__v IS NOT NULL")
    rows = numbered.lateralJoin(source.sparkSession.tvf.variant_explode(F.col("__v").outer())).select("path", "pos", F.col("value").alias("row"))
    is_object = F.coalesce(F.schema_of_variant("row").startswith("OBJECT"), F.lit(False))
    return rows.withColumn("row", F.when(is_object, F.col("row")).otherwise(F.raise_error(F.lit("not an object")).cast("variant"))) if strict else rows.where(is_object)


def seen_ids(spark: SparkSession, root: str) -> DataFrame:
    """(job_id): every id at any depth of every JSON file; unreadable files have none."""
    return files(spark, root).select(F.explode(ids_udf()(_list_of("path", "body"))).alias("job_id")).distinct()


def ads(source: DataFrame, strict: bool = False) -> DataFrame:
    """Loosely typed ads of (path, body) files: pos within the file, ids as text, labels from a list or a text. strict: a file that is not an array of objects fails."""
    rows = rows_of(source, strict).withColumnRenamed("row", "ad")
    text = lambda c: F.try_variant_get("ad", f"$.{c}", "string")
    label_kind = F.schema_of_variant(F.try_variant_get("ad", "$.source_searches", "variant"))
    labels = F.when(label_kind.startswith("ARRAY"), F.try_variant_get("ad", "$.source_searches", "array<string>")).when(label_kind == "STRING", F.array(text("source_searches")))
    fields = ["job_id", "title", "company", "location", "url", "description", "requirements_text", "prefilter_reason"]
    verdict = F.when(F.schema_of_variant(F.try_variant_get("ad", "$.prefilter_pass", "variant")) == "BOOLEAN", F.try_variant_get("ad", "$.prefilter_pass", "boolean"))
    return rows.select("path", "pos", *(text(c).alias(c) for c in fields), clean_labels(labels).alias("source_searches"), verdict.alias("prefilter_pass"), F.to_json("ad").alias("ad_json"))


def input_ads(spark: SparkSession, path: str) -> DataFrame:
    """The ads of a run's metadata.input_path; none if it cannot be read."""
    return ads(files(spark, path) if path else spark.createDataFrame([], "path string, body string"))


def waiting_ads(spark: SparkSession, root: str) -> DataFrame:
    """Unclassified ads of the waiting room in path order, first of an id wins, labels merged."""
    rows = ads(files(spark, f"{root}/waiting_room").where(is_unclassified("path")))
    key = F.coalesce(F.when(F.col("job_id") != "", F.col("job_id")), F.col("ad_json"))
    order = F.struct("path", "pos")
    one = rows.withColumn("__key", key).groupBy("__key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "source_searches"]), order).alias("ad"), F.min(order).alias("at"))
    place = rows.withColumn("__key", key).select("__key", "path", "pos", F.posexplode("source_searches").alias("n", "label"))
    labels = place.withColumn("o", F.struct("path", "pos", "n")).groupBy("__key").agg(merged_labels("label", "o").alias("source_searches"))
    return one.join(labels, "__key").select("ad.*", "source_searches", F.col("at"))


def latest_run(runs: DataFrame, run: str = "run_ts") -> DataFrame:
    """(run_ts): the greatest run folder; fails if there is none."""
    return runs.agg(F.max(run).alias("run_ts")).select(F.coalesce("run_ts", F.raise_error(F.lit("no run")).cast("string")).alias("run_ts"))


def only_input(spark: SparkSession, root: str, run: str) -> str:
    """The one unclassified file of rows of a run; fails on none or several."""
    found = [r.path for r in files(spark, f"{root}/discard/{run}").where(is_unclassified("path")).select(named("path").alias("path")).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"a run needs exactly one input file, found {'several' if found else 'none'}")
    return found[0]


def discard_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_ts) of every run folder under discard."""
    return files(spark, f"{root}/discard").select(run_of("path").alias("run_ts")).where("run_ts <> ''").distinct()


def audits(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows of a file, or of all audit files under a folder, with path and ord (place in the file). A missing file has none, rows that are not objects are left out, a file that is not a list fails."""
    source = files(spark, path).where(F.col("path").rlike(rf"_search_audit\.json{_PART}"))
    listed = F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("ARRAY"), F.lit(False)) | F.col("path").rlike(r"/part-[^/]*$")
    checked = source.withColumn("body", F.when(listed, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("not a list of audits: "), F.col("path")))))
    kinds = [c.split(" ") for c in AUDIT.split(", ")]
    return rows_of(checked).select("path", F.col("pos").cast("long").alias("ord"), *(F.try_variant_get("row", f"$.{n}", t.lower().replace("bigint", "long")).alias(n) for n, t in kinds))


def run_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Run metadata of every *_match_metadata.json, ord by path; bad files are left out."""
    names, counts = ("matcher", "model", "matched_at", "input_path", "timestamp"), ("job_count", "hits_count", "discards_count")
    source = files(spark, root).where(F.col("path").rlike(rf"_match_metadata\.json{_PART}"))
    v = F.try_parse_json("body")
    ok = source.withColumn("v", v).where(F.schema_of_variant("v").startswith("OBJECT"))
    kept = ok.select(F.col("path").alias("metadata_path"), *(F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in names), *(F.try_variant_get("v", f"$.{n}", "long").alias(n) for n in counts), F.col("body"))
    return kept.withColumn("ord", F.col("metadata_path"))


def decisions(spark: SparkSession, metadata_path: str) -> DataFrame:
    """(ord, job_id, title, hit, reason, matcher, stage) of a run: the list within its metadata, or the rows beside it."""
    source = files(spark, metadata_path).withColumn("body", F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json("body"), "$.decisions", "variant")), F.lit("[]")))
    inside = source.select(F.lit("").alias("path"), "body")
    beside = files(spark, metadata_path.replace("_match_metadata.json", "_decisions.json"))
    text = lambda c: F.try_variant_get("row", f"$.{c}", "string").alias(c)
    place = F.coalesce(F.try_variant_get("row", "$.ord", "long"), F.col("pos").cast("long"))
    return rows_of(inside.union(beside)).select(place.alias("ord"), text("job_id"), text("title"), F.try_variant_get("row", "$.hit", "boolean").alias("hit"), text("reason"), text("matcher"), text("stage"))


def write_rows(rows: DataFrame, path: str) -> str:
    """A file of rows: a folder of JSON lines with all fields, nulls too; written in parallel, replaced as a whole."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_bucketed(rows: DataFrame, root: str, run: str) -> None:
    """One pass for all buckets: rows carry bucket; a bucket and run is a partition."""
    rows.withColumn("run_ts", F.lit(run)).write.mode("append").partitionBy("bucket", "run_ts").parquet(root)


def append_stats(stats: DataFrame, path: str) -> None:
    """Adds sorted rows to the stats table (CSV with a header in each file)."""
    stats.orderBy("search_term").coalesce(1).write.mode("append").option("header", True).csv(path)


def hand_off(selected: DataFrame, deferred: DataFrame, root: str, run: str) -> bool:
    """Writes the selected ads to discard and the deferred ones to a new waiting run; only then may the consumed runs be dropped. False: nothing selected, nothing written."""
    if selected.limit(1).count() == 0:
        return False
    write_bucketed(deferred.withColumn("bucket", F.lit("waiting_room")), root, run)
    write_bucketed(selected.withColumn("bucket", F.lit("discard")), root, run)
    return True


def drop_runs(spark: SparkSession, folder: str, keep: str) -> None:
    """Deletes what a bucket's folder holds but keep, through Hadoop's file system, after a hand-off."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        for status in fs.listStatus(path):
            if status.getPath().getName() != keep:
                fs.delete(status.getPath(), True)


def runs_in(spark: SparkSession, root: str, bucket: str) -> list[str]:
    """Names of a bucket's run folders: a listing, not a scan."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{bucket}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []
