"""URL filters: host and path rules by a sort-merge range join, in DataFrame operations only.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
rule string wins, and a url without a rule gets the default verdict. The host's labels are reversed
("www.example.org" is "org.example.www."), so a rule's host is a prefix of every host that it fits, and becomes the interval of keys that start with it. Rule hosts
and urls are sorted together by this key and swept once. Intervals are nested, and those of one depth (number of labels) are disjoint: so the stack of active rule hosts is, for each depth, the
one opened last, as long as it still is a prefix of the key. Each url goes on to a second sweep with the rule hosts that were active at it, sorted by path: there the
rule that opened last carries its stack of enclosing rules, and is popped to the longest that is still a prefix of the path.

Scale: equal (host, path) pairs meet in one row first. Both sweeps run in salts, one for each TARGET urls counted under a top-level label or a rule host,
so that one that holds a third of all urls ("com") is spread; rules are repeated for each salt. Rules may be as many as urls: nothing is broadcast unless Spark finds it below its own
limit. The driver sees the depths of the rule hosts (127 at most in the domain name system).

Defined cases: a null url, or one without "://", has an empty host and path and fits no rule; an empty host or a path shorter than the
rule's fits none; repeated pages give repeated rows; ties (one rule given twice) give the
stricter verdict (block); an empty table gives an empty result; columns named host, path, rule and verdict are replaced, others are carried and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, without

#: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"
TARGET = 1_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def stacked(rules: DataFrame) -> DataFrame:
    """(level, path, rule, verdict, stack): stack holds the rules of the level whose path is a prefix of this one's, longest first."""
    own = rules.select(reversed_host(F.lower("host")).alias("level"), "path", F.concat(F.lower("host"), "path").alias("rule"), "verdict")
    own = own.groupBy("level", "path").agg(F.min("rule").alias("rule"), F.max("verdict").alias("verdict"))
    ends = F.sequence(F.lit(0), F.char_length("path"))
    up = own.select("level", F.col("path").alias("under"), F.explode(F.transform(ends, lambda n: F.col("path").substr(F.lit(1), n))).alias("path"))
    stack = F.reverse(F.array_sort(F.collect_list(F.struct(F.char_length("path").alias("n"), "path", "rule", "verdict"))))
    stacks = up.join(own, ["level", "path"]).groupBy("level", "under").agg(stack.alias("stack"))
    return own.join(stacks.withColumnRenamed("under", "path"), ["level", "path"])


def _salted(rows: DataFrame, by: str, target: int) -> DataFrame:
    """(by, salts): how many salts each value of by has."""
    return cut(rows.groupBy(by).agg(F.ceil(F.count("*") / F.lit(target)).cast("int").alias("salts")))


def active(urls: DataFrame, levels: DataFrame, target: int) -> DataFrame:
    """(host, path, level): every distinct url with each rule host whose interval it lies in, by one sweep. levels: (level), reversed rule hosts."""
    depth = F.char_length("level") - F.char_length(F.replace("level", F.lit("."), F.lit("")))
    top = lambda key: F.substring_index(key, ".", 1)
    opened = levels.select(F.col("level").alias("key"), depth.alias("depth"), top("level").alias("top"))
    points = urls.where("host <> ''").select("host", "path").distinct().withColumn("key", reversed_host(F.col("host"))).withColumn("top", top("key"))
    points = cut(points.join(opened.select("top").distinct(), "top", "left_semi"))
    depths = sorted(r["depth"] for r in opened.select("depth").distinct().collect())
    if not depths:
        return points.select("host", "path", F.col("key").alias("level"))
    salts = _salted(points, "top", target)
    none = F.lit(None).cast("string")
    asked = points.join(salts, "top").select("top", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"), "key", F.lit(1).alias("kind"), F.lit(0).alias("depth"), "host", "path")
    starts = opened.join(salts, "top").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("top", "salt", "key", F.lit(0).alias("kind"), "depth", none.alias("host"), none.alias("path"))
    sweep = Window.partitionBy("top", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = F.array(*(F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.col("key")), ignorenulls=True).over(sweep) for d in depths))
    swept = starts.union(asked).withColumn("stack", stack).where("kind = 1")
    return swept.select("host", "path", F.explode(F.filter("stack", lambda x: F.startswith(F.col("key"), x))).alias("level"))


def judged(urls: DataFrame, rules: DataFrame, target: int = TARGET) -> DataFrame:
    """(host, path, rule, verdict) of every (host, path) of urls that a rule fits."""
    rules = stacked(rules)
    points = cut(active(urls, rules.select("level").distinct(), target))
    salts = _salted(points, "level", target)
    opened = rules.join(salts, "level").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    opened = opened.select("level", "salt", "path", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    asked = points.join(salts, "level").withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int"))
    asked = asked.select("level", "salt", "path", F.lit(1).alias("kind"), "host", F.lit(None).cast(opened.schema["stack"].dataType).alias("stack"))
    sweep = Window.partitionBy("level", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = opened.union(asked).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    open_rules = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    hits = swept.select("host", "path", F.try_element_at(open_rules, F.lit(1)).alias("top")).where("top IS NOT NULL")
    strength = F.struct(F.char_length("top.rule"), "top.rule")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(strength.alias("by"), F.col("top.verdict").alias("verdict"))).alias("best"))
    return best.select("host", "path", F.col("best.by.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """The rules as a local relation: built by the JVM, without Python on executors."""
    values = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")


def filtered(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict instead of columns of these names."""
    own = pages.select("*", *(c.alias(n) for n, c in zip(("__host", "__path"), host_and_path(F.col(url)), strict=True)))
    own = without(own, "host", "path", "rule", "verdict").withColumnsRenamed({"__host": "host", "__path": "path"})
    found = cut(judged(own, rules))  # so that the join below can be split where one url is on very many pages
    return own.join(found, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = filtered(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark))
    return done.select("page_id", "host", "path", "rule", "verdict")


_FITS = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in RULES)
ORACLE_SQL = f"""
WITH r AS ({_FITS}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT rid, page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT rid, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, h || p DESC) AS k
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM s LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (rid)
"""
