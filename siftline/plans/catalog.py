"""The registered queries and their DuckDB equivalents: every operator on the nearest of the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html, jsonx, recency, screen, sections, textx, urls
from ..operators import capture, evaluate, queue, report, stats
from ..streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Words that occur in the documents, for the screen.
GOOD, BAD, KINDS = ["of", "license", "für", "que la"], ["und", "de"], {"und": "german"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_flag = textx.duckdb_keyword
_good = "[k.w FOR k IN [" + ", ".join(f"{{'w': '{w}', 'hit': {_flag('text', w)}}}" for w in GOOD) + "] IF k.hit]"
_bad = "[k.w FOR k IN [" + ", ".join(f"{{'w': '{w}', 'hit': {_flag('text', w)}}}" for w in BAD) + "] IF k.hit]"
_verdict = f"SELECT doc_id, source, {_good} AS good, {_bad} AS bad FROM documents"


def _screened(spark: SparkSession, d: str) -> DataFrame:
    return screen.with_verdict(t(spark, d, "documents").select("doc_id", "source", "text"), {"description": F.col("text")}, GOOD, BAD, KINDS)


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def scan_project_documents(spark, d):
    return t(spark, d, "documents").where("lang = 'en' AND n_chars > 500").select("doc_id", "lang", "source", "n_chars")


@query(f"SELECT doc_id, {_flag('text', 'the')} AS hit FROM documents")
def screen_flag(spark, d):
    return t(spark, d, "documents").select("doc_id", textx.keyword_flag("text", "the").alias("hit"))


@query(f"SELECT doc_id, array_to_string({_good}, ',') AS found FROM documents")
def screen_keyword_list(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text").withColumn("fold", textx.folded("text"))
    return docs.select("doc_id", F.array_join(textx.keyword_matches("text", GOOD, "fold"), ",").alias("found"))


@query(
    f"""SELECT doc_id, len(good) > 0 OR len(bad) = 0 AS passed,
    CASE WHEN len(good) > 0 THEN 'Matched description keyword: ' || good[1] WHEN len(bad) > 0 THEN 'Rejected obvious ' || CASE bad[1] WHEN 'und' THEN 'german' ELSE 'non-match' END || ' role: ' || bad[1]
    ELSE '{screen.PERMISSIVE}' END AS reason FROM ({_verdict})"""
)
def screen_verdict(spark, d):
    return _screened(spark, d).select("doc_id", F.col("prefilter_pass").alias("passed"), F.col("prefilter_reason").alias("reason"))


@query(
    f"""SELECT v.source, count(*) AS new_ads, count(*) FILTER (len(good) > 0 OR len(bad) = 0) AS passed, count(*) FILTER (len(good) = 0 AND len(bad) > 0) AS rejected,
    count(*) FILTER (l.doc_id IS NOT NULL) AS already_in_memory FROM ({_verdict}) v LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY v.source"""
)
def screen_by_source_stats(spark, d):
    seen = t(spark, d, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True))
    rows = _screened(spark, d).select("doc_id", "source", screen.passes("prefilter_pass").alias("ok")).join(seen, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("new_ads"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("rejected"), F.count_if(F.col("seen").isNotNull()).alias("already_in_memory")).orderBy("source")


@query(f"SELECT doc_id, md5(trim(regexp_replace(text, '{textx.DUCKDB_SPACE}+', ' ', 'g'))) AS digest FROM documents")
def collapse_whitespace(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(textx.collapse("text").cast("binary")).alias("digest"))


@query("SELECT p_partkey, concat_ws(chr(10), 'Title: ' || nullif(trim(p_name), ''), 'Company: ' || nullif(trim(p_brand), ''), 'Description: ' || nullif(trim(p_type), '')) AS ad FROM part")
def job_text_concat(spark, d):
    ads = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.lit(None).cast("string").alias("location"), F.col("p_type").alias("description"))
    return ads.select("p_partkey", evaluate.ad_text().alias("ad"))


@query("SELECT c_custkey, c_name AS title, c_mktsegment AS requirements FROM customer")
def compact_fields(spark, d):
    ads = t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("title"), F.lit("").alias("company"), F.lit(None).cast("string").alias("location"), F.lit(" ").alias("requirements_text"), F.col("c_mktsegment").alias("description"))
    packed = ads.select("c_custkey", evaluate.compact_ad(F.col("c_custkey").cast("string")).alias("ad"))
    return packed.select("c_custkey", F.get_json_object("ad", "$.title").alias("title"), F.get_json_object("ad", "$.requirements").alias("requirements"))


@query("SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'system' THEN '' ELSE role || turn END, ''), 'index-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)) AS candidate_id FROM conversations")
def candidate_id_fallback(spark, d):
    rows = t(spark, d, "conversations").withColumn("job_id", F.when(F.col("role") == "system", "").otherwise(F.concat("role", F.col("turn").cast("string"))))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return rows.select("conv_id", "turn", evaluate.candidate_id("job_id", place).alias("candidate_id"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    p AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i)the')), true) AS a FROM l),
    s AS (SELECT doc_id, CASE WHEN a > 0 THEN ls[a:] END AS rest FROM p),
    e AS (SELECT doc_id, rest, list_position(list_transform(rest[2:], lambda x: regexp_matches(x, '(?i)license')), true) AS b FROM s)
    SELECT doc_id, md5(coalesce(array_to_string(CASE WHEN b > 0 THEN rest[1:b] ELSE rest END, chr(10)), '')) AS digest FROM e"""
)
def segment_section_lines(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    first = F.array_position(F.transform("ls", lambda x: x.rlike("(?i)the")), True)
    rest = F.when(first > 0, F.slice("ls", F.greatest(first, F.lit(1)).cast("int"), F.size("ls")))
    docs = docs.select("doc_id", rest.alias("rest"))
    stop = F.array_position(F.transform(F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1))), lambda x: x.rlike("(?i)license")), True)
    kept = F.when(stop > 0, F.slice("rest", 1, stop.cast("int"))).otherwise(F.col("rest"))
    return docs.select("doc_id", F.md5(F.coalesce(F.array_join(kept, "\n"), F.lit("")).cast("binary")).alias("digest"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages")
def page_title_h1(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def page_links_explode(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


# Text of the pages in SQL: a script's tags are no tags, a cut-off tag at the end is no text.
_MASKED = """regexp_replace(regexp_replace(replace(html, '"</p>"', '"' || chr(1) || '/p' || chr(2) || '"'), '<!--.*?-->', chr(3), 'gs'), '<[^>]*$', '')"""


def _tidied(c: str) -> str:
    for entity, char in (("&amp;", "&"), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return f"trim(regexp_replace(replace(replace({c}, chr(1), '<'), chr(2), '>'), '{textx.DUCKDB_SPACE}+', ' ', 'g'))"


_LINES = r"regexp_replace(regexp_replace(replace(m, chr(3), ''), '<(br|p|li|ul|ol)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"


@query(f"SELECT page_id, {_tidied(_LINES)} AS body FROM (SELECT page_id, {_MASKED} AS m FROM pages)")
def page_text_udf(spark, d):
    return t(spark, d, "pages").select("page_id", html.text_udf("html").alias("body"))


@query(
    f"""WITH p AS (SELECT page_id, string_split_regex({_MASKED}, '</?(br|div|h[1-5]|li|ol|p|ul)\\b[^>]*>') AS parts FROM pages),
    b AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p),
    x AS (SELECT page_id, i, {_tidied("regexp_replace(replace(part, chr(3), ' '), '<[^>]*>', ' ', 'g')")} AS text FROM b)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS ord, text FROM x WHERE text <> ''"""
)
def page_blocks(spark, d):
    return t(spark, d, "pages").select("page_id", F.inline(html.segments_udf("html"))).select("page_id", "ord", "text")


@query()
def page_segments_udf(spark, d):
    return t(spark, d, "pages").select("page_id", F.inline(html.segments_udf("html"))).select("page_id", "ord", "text", F.array_join("tags", ",").alias("tags"))


# A card with a field inside a field, a link with entities and spaces, and every field that cards have.
_CARD = """'<div class="x base-card" data-entity-urn="urn:li:jobPosting:' || page_id || '"><a class="base-card__full-link" href=" /v?a=1&amp;amp;p=' || page_id || ' ">Link <b>' || page_id || '</b></a><h3 class="base-search-card__title">Ad &amp;amp; <i class="base-search-card__title">' || page_id || '</i></h3><a class="hidden-nested-link" href="/c">Co<span class="job-search-card__location">no</span></a><span class="job-search-card__location">Here</span><time class="job-search-card__listdate--new" datetime="2024-01-01">1 day ago</time></div>'"""


@query("SELECT page_id::BIGINT AS page_id, page_id::VARCHAR AS job_id, 'Ad & ' || page_id AS title, 'Cono' AS company, '/c' AS company_url, 'Here' AS location, '' AS benefit, '1 day ago' AS posted, '2024-01-01' AS posted_date, '/v?a=1&p=' || page_id AS url FROM pages")
def card_parse_udf(spark, d):
    """Two cards' worth of markup around each page's id; the page itself comes first and holds no card."""
    pages = t(spark, d, "pages").select("page_id", F.concat("html", F.expr(_CARD)).alias("html"))
    return pages.select("page_id", F.inline(html.cards_udf("html"))).withColumn("page_id", F.col("page_id").cast("long"))


_TAG = "CASE p_size % 3 WHEN 0 THEN 'h5' WHEN 1 THEN 'strong' ELSE 'p' END"
_HEADING = "CASE p_size % 4 WHEN 0 THEN 'Requirements.' WHEN 1 THEN 'Krav:' WHEN 2 THEN 'About you' ELSE 'We are many.' END"
_DETAIL = f"""concat('<h2 class="top-card-layout__title">', p_name, '</h2><div class="a show-more-less-html__markup"><p>Intro</p><', {_TAG}, '>', {_HEADING}, '</', {_TAG}, '><ul><li>', p_type, '</li></ul><section>more</section><p><strong>About us</strong></p><p>Cake</p></div><p>z</p>')"""


@query(
    f"""WITH x AS (SELECT p_partkey, p_name AS title, p_type, p_size, 'Intro' || CASE WHEN p_size % 3 = 2 THEN ' ' ELSE '' END || {_HEADING} || ' ' || p_type || 'more About us Cake' AS description FROM part)
    SELECT p_partkey, title, description, CASE WHEN p_size % 4 < 3 THEN {_HEADING} || chr(10) || p_type || chr(10) || 'more' ELSE description END AS requirements_text, CASE WHEN p_size % 4 < 3 THEN 'pattern' ELSE 'full_description' END AS method FROM x"""
)
def ad_sections(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.expr(_DETAIL).alias("html"), F.col("p_partkey").cast("string").alias("job_id"))
    cards = rows.select("p_partkey", "job_id", *(F.lit("").alias(c) for c in ("title", "company", "posted")))
    found = capture.with_details(cards, rows.select("job_id", F.lit(200).alias("status"), "html"))
    return found.select("p_partkey", "title", "description", "requirements_text", F.col("requirements_extraction_method").alias("method"))


@query(
    """SELECT n_nationkey::BIGINT AS ord, n_regionkey::VARCHAR AS search, 1::BIGINT AS pages_requested, 1::BIGINT AS results_seen, (n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))::BIGINT AS already_in_memory, false AS throttled FROM nation"""
)
def capture_audits(spark, d):
    """Five searches share each label; each has an audit of its own."""
    card = """concat('<div class="base-card" data-entity-urn="a:jobPosting:', n_nationkey, '"><h3 class="base-search-card__title">', n_name, '</h3></div>')"""
    pages = t(spark, d, "nation").select(F.col("n_nationkey").alias("search_ord"), F.col("n_regionkey").cast("string").alias("label"), F.lit(0).alias("page_no"), F.lit(200).alias("status"), F.expr(card).alias("html"))
    seen = t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("string").alias("job_id"))
    return capture.capture(pages, seen, F.lit("2024-01-20").cast("date"), 100)[1].drop("passed_prefilter")


@query(
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '[?&]page=([^&#]+)', 1) AS pg, regexp_extract(url, '[?&]utm_source=([^&#]+)', 1) AS utm FROM pages)
    SELECT page_id, CASE WHEN pg <> '' THEN pg WHEN utm <> '' THEN 'geo-only' ELSE url END AS label FROM p"""
)
def url_label(spark, d):
    label = F.coalesce(urls.query_param("url", "page"), F.when(urls.query_param("url", "utm_source").isNotNull(), urls.GEO_ONLY), F.col("url"))
    return t(spark, d, "pages").select("page_id", label.alias("label"))


@query("SELECT p_partkey, 'keywords=' || replace(url_encode(p_name || ' *~é'), '%20', '+') || '&f_TPR=' || p_size AS query FROM part")
def url_build(spark, d):
    return t(spark, d, "part").select("p_partkey", urls.build_query({"keywords": F.concat("p_name", F.lit(" *~é")), "location": F.lit(""), "f_TPR": F.col("p_size").cast("string")}).alias("query"))


_AGE = "CASE doc_id % 4 WHEN 0 THEN (doc_id % 50) || ' minutes ago' WHEN 1 THEN (doc_id % 30) || ' hours ago' WHEN 2 THEN '30+ days ago' ELSE NULL END"
_DATE = "CASE WHEN doc_id % 3 = 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE 'soon' END"


@query(
    f"""WITH c AS (SELECT doc_id, {_AGE} AS posted, {_DATE} AS pd FROM documents),
    k AS (SELECT doc_id, CASE WHEN regexp_matches(posted, '[0-9]+ (minute|hour)') THEN regexp_extract(posted, '([0-9]+)', 1)::BIGINT * CASE WHEN posted LIKE '%hour%' THEN 60 ELSE 1 END END AS rel,
      CASE WHEN pd <> 'soon' THEN greatest(date_diff('day', pd::DATE, DATE '2024-01-20'), 0) END AS days FROM c)
    SELECT doc_id, CASE WHEN rel IS NOT NULL THEN 0 WHEN days IS NOT NULL THEN 1 ELSE 2 END AS posted_class, coalesce(rel, days, 0)::BIGINT AS posted_value FROM k ORDER BY 2, 3, 1 LIMIT 100"""
)
def recency_rank_topk(spark, d):
    age = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(doc_id % 50, ' minutes ago') WHEN 1 THEN concat(doc_id % 30, ' hours ago') WHEN 2 THEN '30+ days ago' END")
    date = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('2024-01-', lpad(doc_id % 28 + 1, 2, '0')) ELSE 'soon' END")
    cards = t(spark, d, "documents").select("doc_id", age.alias("posted"), date.alias("posted_date"))
    keyed = cards.withColumns(recency.posted_key("posted", "posted_date", F.lit("2024-01-20").cast("date")))
    return keyed.orderBy("posted_class", "posted_value", "doc_id").limit(100).select("doc_id", "posted_class", "posted_value")


@query("SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id")
def dedupe_first_wins(spark, d):
    return capture.first_wins(t(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id", None).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS labels FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def dedupe_merge_labels(spark, d):
    rows = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))  # repeats go before the lists are built
    return rows.groupBy("user_id").agg(F.array_join(capture.merged_labels("event_type", "event_id"), ",").alias("labels"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def dedupe_last_wins(spark, d):
    return capture.last_wins(t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_memory(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_candidates(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT source AS label, count(*) FILTER (l.doc_id IS NOT NULL) AS already_in_memory FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def already_in_memory_counts(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.col("source").alias("label"))
    return capture.memory_hits(rows, t(spark, d, "labels").select(F.col("doc_id").alias("job_id")))


@query("SELECT o_custkey, o_orderkey, results FROM (SELECT *, min(results >= 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ok FROM (SELECT o_custkey, o_orderkey, count(*) AS results FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)) WHERE coalesce(ok, true)")
def take_while_pages(spark, d):
    sizes = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("results"))
    pages = t(spark, d, "orders").select("o_custkey", "o_orderkey").join(sizes, "o_orderkey")
    return capture.take_while_full(pages, page_size=3, by="o_custkey", page="o_orderkey").select("o_custkey", "o_orderkey", "results")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'hits' ELSE 'discard' END AS bucket FROM labels")
def hit_discard_union(spark, d):
    rows = t(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("hit"))
    return rows.where("hit").select("doc_id", F.lit("hits").alias("bucket")).unionByName(rows.where(~F.coalesce("hit", F.lit(False))).select("doc_id", F.lit("discard").alias("bucket")))


@query(f"SELECT d.doc_id, coalesce(l.quality = 1, false) AS hit, coalesce('quality ' || l.quality, '{evaluate.TRIAGE_REJECTION}') AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def decision_left_outer_default(spark, d):
    rows = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("hit"), F.coalesce(F.concat(F.lit("quality "), F.col("quality").cast("string")), F.lit(evaluate.TRIAGE_REJECTION)).alias("reason"))


@query("SELECT vec_id AS ord, CASE WHEN label % 2 = 0 THEN 'hits' ELSE 'discard' END AS bucket FROM embeddings")
def ordinal_zip(spark, d):
    rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("job_id"), F.lit("t").alias("title"), F.lit("").alias("description"), "label")
    decisions = rows.select("ord", (F.col("label") % 2 == 0).alias("hit"))
    return evaluate.routed(rows.drop("label"), decisions).select("ord", "bucket")


@query("SELECT doc_id, ok AND k > 300 AS deferred FROM (SELECT doc_id, ok, sum(ok::INT) OVER (ORDER BY doc_id) AS k FROM (SELECT doc_id, toxic = 0 AS ok FROM labels))")
def queue_cap_running_count(spark, d):
    ads = t(spark, d, "labels").select("doc_id", (F.col("toxic") == 0).alias("prefilter_pass"))
    chosen, deferred = queue.split_by_cap(ads, 300, ord_="doc_id")
    return chosen.select("doc_id", F.lit(False).alias("deferred")).union(deferred.select("doc_id", F.lit(True)))


@query("SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS passing_rank FROM conversations")
def queue_running_rank(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("ok"))
    return queue.running_rank(rows, "ok", "turn", by="conv_id").select("conv_id", "turn", "passing_rank")


_AUDITS = "SELECT o_orderkey AS ord, o_orderpriority AS search, 1 AS pages_requested, o_custkey % 7 AS results_seen, o_custkey % 3 AS already_in_memory, NULL::BIGINT AS passed_prefilter, o_orderstatus = 'P' AS throttled FROM orders"


def _audits(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("search"), F.lit(1).cast("long").alias("pages_requested"), (F.col("o_custkey") % 7).alias("results_seen"), (F.col("o_custkey") % 3).alias("already_in_memory"), F.lit(None).cast("long").alias("passed_prefilter"), (F.col("o_orderstatus") == "P").alias("throttled"))


@query(f"SELECT search, sum(pages_requested)::BIGINT AS pages_requested, sum(results_seen)::BIGINT AS results_seen, sum(already_in_memory)::BIGINT AS already_in_memory, 0::BIGINT AS passed_prefilter, bool_or(throttled) AS throttled FROM ({_AUDITS}) GROUP BY search")
def audit_merge(spark, d):
    return stats.merge_audits(_audits(spark, d))


@query("SELECT source AS search, sum(passed)::BIGINT AS passed_prefilter FROM (SELECT source, count(*) AS passed FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source) GROUP BY source")
def audit_prefilter_counts(spark, d):
    ads = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select(F.array("source").alias("source_searches"), (F.col("quality") == 1).alias("prefilter_pass"))
    audits = t(spark, d, "documents").groupBy(F.col("source").alias("search")).agg(F.min("doc_id").alias("ord")).withColumn("passed_prefilter", F.lit(0).cast("long"))
    return stats.add_passed(audits, ads).where("passed_prefilter > 0").select("search", "passed_prefilter")


_DEC = "SELECT doc_id, unnest([source, lang]) AS label, CASE doc_id % 4 WHEN 0 THEN 'prefilter' WHEN 1 THEN 'triage' WHEN 2 THEN 'confirmation' END AS stage, toxic = 1 AS hit FROM documents JOIN labels USING (doc_id)"


def _decided(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "documents").select("doc_id", "source", "lang").join(t(spark, d, "labels"), "doc_id")
    stage: Column = F.expr("CASE doc_id % 4 WHEN 0 THEN 'prefilter' WHEN 1 THEN 'triage' WHEN 2 THEN 'confirmation' END")
    return rows.select("doc_id", F.explode(F.array("source", "lang")).alias("label"), stage.alias("stage"), (F.col("toxic") == 1).alias("hit"))


@query(
    f"""SELECT label, count(*) AS new_ads, count(*) FILTER (stage IS DISTINCT FROM 'prefilter') AS passed_prefilter, count(*) FILTER (stage = 'prefilter') AS rejected_by_prefilter,
    count(*) FILTER (stage IS DISTINCT FROM 'prefilter') AS triaged_ads, count(*) FILTER (stage = 'confirmation') AS confirmation_candidates,
    count(*) FILTER (hit AND (stage IS NULL OR stage = 'confirmation')) AS matches, count(*) FILTER (stage = 'triage') AS rejected_by_triage,
    count(*) FILTER (stage = 'confirmation' AND NOT hit) AS discarded_after_confirmation FROM ({_DEC}) GROUP BY label"""
)
def label_stats_exploded(spark, d):
    return stats.label_stats(_decided(spark, d))


@query(f"SELECT label, count(*) FILTER (stage IS DISTINCT FROM 'prefilter') AS passed, count(*) FILTER (stage = 'prefilter') AS rejected, count(*) FILTER (stage = 'confirmation') AS confirmed, count(*) FILTER (hit) AS hits FROM ({_DEC}) GROUP BY label")
def label_counts(spark, d):
    return stats.label_counts(_decided(spark, d))


_ADS = "SELECT doc_id AS ord, (doc_id % 700)::VARCHAR AS job_id, CASE WHEN doc_id % 3 = 0 THEN ['geo-only'] WHEN doc_id % 3 = 1 THEN ['geo-only', source] ELSE [source] END AS labels, lang <> 'de' AS ok FROM documents"


@query(
    f"""WITH a AS (SELECT job_id, arg_min(labels, ord) AS labels, arg_min(ok, ord) AS ok FROM ({_ADS}) GROUP BY job_id),
    g AS (SELECT sum(o_custkey % 7)::BIGINT AS visible, sum(o_custkey % 3)::BIGINT AS mem FROM orders WHERE o_orderpriority = '1-URGENT'),
    f AS (SELECT list_contains(labels, 'geo-only') AS geo, len(list_filter(labels, lambda x: x <> 'geo-only')) > 0 AS word, ok FROM a)
    SELECT 0 AS metric_ord, 'Geo-visible jobs' AS metric, visible AS value FROM g UNION ALL SELECT 1, 'Seen by keyword searches', count(*) FILTER (geo AND word) FROM f
    UNION ALL SELECT 2, 'Geo-only only', count(*) FILTER (geo AND NOT word) FROM f UNION ALL SELECT 3, 'Already in memory', mem FROM g UNION ALL SELECT 4, 'New to memory', count(*) FROM f
    UNION ALL SELECT 5, 'Passed Eval 1: Keywords', count(*) FILTER (ok) FROM f UNION ALL SELECT 6, 'Rejected by Eval 1: Keywords', count(*) FILTER (NOT ok) FROM f"""
)
def coverage_metrics_unpivot(spark, d):
    labels = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("geo-only"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("geo-only"), F.col("source"))).otherwise(F.array("source"))
    ads = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), (F.col("doc_id") % 700).cast("string").alias("job_id"), labels.alias("source_searches"), (F.col("lang") != "de").alias("prefilter_pass"))
    audits = _audits(spark, d).withColumn("search", F.when(F.col("search") == "1-URGENT", "geo-only").otherwise(F.col("search")))
    return stats.coverage(audits, ads)


@query(
    f"""WITH m AS (SELECT search, sum(results_seen)::BIGINT AS results_seen FROM ({_AUDITS}) GROUP BY search),
    c AS (SELECT o_orderpriority || CASE WHEN o_orderstatus = 'P' THEN '?' ELSE '' END AS search, count(*) FILTER (o_orderstatus = 'F') AS hits FROM orders GROUP BY 1)
    SELECT coalesce(m.search, c.search) AS search, coalesce(results_seen, 0) AS results_seen, coalesce(hits, 0) AS hits FROM m FULL JOIN c ON m.search = c.search"""
)
def audit_full_outer(spark, d):
    audits = stats.merge_audits(_audits(spark, d))
    counts = stats.label_counts(t(spark, d, "orders").select(F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "P", "?").otherwise("")).alias("label"), F.lit("triage").alias("stage"), (F.col("o_orderstatus") == "F").alias("hit")))
    return stats.audit_report(audits, counts).select("search", "results_seen", "hits")


@query("SELECT coalesce(sum(user_id), 0)::BIGINT AS considered FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 12 HOURS")
def rolling_window_count(spark, d):
    runs = t(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("matched_at"), F.col("user_id").alias("job_count"))
    return report.considered_since(runs, F.lit("2024-01-15 12:00:00").cast("timestamp"))


@query(
    """SELECT w AS window_start, count(*) AS n FROM (SELECT ts, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 11 HOURS, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS w FROM events) GROUP BY w"""
)
def sliding_window_counts(spark, d):
    return watch.sliding_counts(t(spark, d, "events").select("ts"))


@query("SELECT DISTINCT id FROM (SELECT doc_id::VARCHAR AS id FROM documents UNION SELECT doc_id::VARCHAR FROM labels UNION SELECT item_id::VARCHAR FROM benchmark)")
def distinct_ids_union(spark, d):
    one = lambda n, c: t(spark, d, n).select(F.col(c).alias("job_id"))
    return report.distinct_ids(one("documents", "doc_id"), one("labels", "doc_id"), one("benchmark", "item_id"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS id FROM events WHERE json_extract_string(props, '$.k') <> ''")
def json_ids_at_any_depth(spark, d):
    return t(spark, d, "events").select("event_id", F.explode(jsonx.ids_udf("k")("props")).alias("id"))


@query("SELECT json_extract_string(props, '$.k') AS id, count(*) AS n FROM events GROUP BY 1")
def json_ids_recursive(spark, d):
    kinds = t(spark, d, "events").groupBy("props").agg(F.count("*").alias("n"))  # equal texts are walked once
    found = jsonx.ids_recursive(spark, kinds.select("props"), "props", "k").distinct()
    own = kinds.select(F.get_json_object("props", "$.k").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n"))
    return found.join(own, "id")


@query("SELECT event_type, max(ts) AS matched_at, arg_max(event_id, (ts, -event_id)) AS event_id FROM events GROUP BY event_type")
def latest_run_argmax(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("matched_at"), F.max_by("event_id", F.struct("ts", -F.col("event_id"))).alias("event_id"))


@query(
    """SELECT l.doc_id AS ord, l.doc_id::VARCHAR AS job_id, coalesce(nullif(d.source, ''), 'Untitled job') AS title, coalesce(d.lang, '') AS url, 'quality ' || quality AS reason
    FROM labels l LEFT JOIN (SELECT doc_id::VARCHAR AS k, source, lang FROM documents) d ON l.doc_id::VARCHAR = d.k WHERE toxic = 1"""
)
def hit_report_join(spark, d):
    ads = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("job_id"), F.col("source").alias("title"), F.col("lang").alias("url"))
    rows = t(spark, d, "labels").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("job_id"), F.lit("").alias("title"), (F.col("toxic") == 1).alias("hit"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("reason"))
    return report.current_hits(rows, ads)


_MESSAGE = "string_agg(chr(10) || n || '. ' || role || chr(10) || 'No URL in scraped ad.' || chr(10) || 'Reason: ' || text, '' ORDER BY n)"


@query(
    f"""WITH m AS (SELECT conv_id, {_MESSAGE} AS m FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) GROUP BY conv_id)
    SELECT conv_id, length(m) AS n_chars, md5(CASE WHEN length(m) > {report.LIMIT} THEN left(m, {report.LIMIT - len(report.SUFFIX)}) || chr(10) || chr(10) || '[truncated]' ELSE m END) AS digest FROM m"""
)
def message_listagg(spark, d):
    rows = t(spark, d, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).withColumn("url", F.lit(""))
    blocks = F.array_sort(F.collect_list(F.struct("n", report.hit_block(F.col("n"), "role", "url", "text").alias("b"))))
    made = rows.groupBy("conv_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "").alias("m"))
    return made.select("conv_id", F.char_length("m").cast("long").alias("n_chars"), F.md5(report.truncated("m").cast("binary")).alias("digest"))


_BODY = "CASE event_id % 4 WHEN 0 THEN '{\"hit\": true, \"reason\": \" ' || event_type || ' \"}' WHEN 1 THEN '{\"hit\": \"true\", \"reason\": \"x\"}' WHEN 2 THEN '{\"hit\": false, \"reason\": \" \"}' ELSE 'no json' END"


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'true' END AS hit, CASE WHEN event_id % 4 = 0 THEN event_type END AS reason, CASE event_id % 4 WHEN 1 THEN 'hit is not a boolean' WHEN 2 THEN 'reason is blank' WHEN 3 THEN 'not JSON' END AS error FROM events")
def response_parse_strict(spark, d):
    return t(spark, d, "events").select("event_id", jsonx.parsed_match(F.expr(_BODY)).alias("p")).select("event_id", F.col("p.hit").cast("string").alias("hit"), "p.reason", "p.error")


@query("SELECT event_id, event_type || (event_id % 3) AS body FROM events")
def response_text_nested(spark, d):
    bodies = F.expr("""CASE event_id % 2 WHEN 0 THEN concat('{"output_text": "', event_type, event_id % 3, '"}') ELSE concat('{"output": [{"content": [{"type": "output_text", "text": "', event_type, '"}]}, {"content": [{"text": "', event_id % 3, '"}]}]}') END""")
    return t(spark, d, "events").select("event_id", jsonx.response_text(bodies).alias("body"))


@query("SELECT p_partkey, least(2048, greatest(256, 160 + 120 * greatest(p_size - 5, 0))) AS tokens FROM part")
def token_budget(spark, d):
    return t(spark, d, "part").select("p_partkey", evaluate.token_budget(F.col("p_size") - 5).alias("tokens"))


@query("SELECT doc_id, 'job-profile:' || left(sha256(text), 16) AS cache_key FROM documents")
def profile_key(spark, d):
    return t(spark, d, "documents").select("doc_id", evaluate.profile_key(F.col("text")).alias("cache_key"))


@query("SELECT event_id, hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Stockholm') IN (7, 19) AS due FROM events")
def hour_gate(spark, d):
    return t(spark, d, "events").select("event_id", recency.report_due(F.col("ts")).alias("due"))


@query(
    f"SELECT doc_id AS ord, {_flag('text', 'the')} AS hit, CASE WHEN {_flag('text', 'the')} THEN '{evaluate.MOCK_REASONS[0]}' ELSE '{evaluate.MOCK_REASONS[1]}' END AS reason, CASE WHEN {_flag('text', 'the')} THEN 'Eval 3: LLM confirmation' ELSE 'unknown' END AS stage_label FROM documents"
)
def mock_decision(spark, d):
    ads = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("job_id"), F.col("source").alias("title"), F.col("text").alias("description"))
    done = evaluate.mock_decisions(ads, "the")
    return done.select("ord", "hit", "reason", evaluate.stage_label("stage", "hit").alias("stage_label"))


class RuleProvider:
    """Answers by a fixed rule: triage picks titles that end in 1, 3 or 5; ads of companies that start with e are confirmed."""

    name, model = "rule", "rule-1"

    def triage(self, ads: list[dict], profile: str) -> evaluate.Reply:
        return evaluate.Reply(json.dumps({"candidates": [{"candidate_id": a["candidate_id"], "reason": "title"} for a in ads if a.get("title", "")[-1:] in ("1", "3", "5")]}))

    def confirm(self, ad: dict, profile: str) -> evaluate.Reply:
        hit = ad.get("company", "").startswith("e")
        return evaluate.Reply(json.dumps({"hit": hit, "reason": "company" if hit else "no company"}))


@query(
    """SELECT doc_id AS ord, n_chars > 300 AND right(source, 1) IN ('1', '3', '5') AND lang LIKE 'e%' AS hit,
    CASE WHEN NOT n_chars > 300 THEN 'prefilter' WHEN right(source, 1) IN ('1', '3', '5') THEN 'confirmation' ELSE 'triage' END AS stage FROM documents"""
)
def two_stage_fake_provider(spark, d):
    ads = t(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("job_id"), F.col("source").alias("title"), F.col("lang").alias("company"), F.lit("").alias("location"), F.lit("").alias("description"), F.lit("").alias("requirements_text"), (F.col("n_chars") > 300).alias("prefilter_pass"), F.lit(None).cast("string").alias("prefilter_reason"))
    keep = lambda df, stage: df  # noqa: E731  the rule answers the same at every call, so nothing need be written
    return evaluate.two_stage(ads, RuleProvider(), "profile", keep, batch_size=256).select("ord", "hit", "stage")


@query("SELECT o_orderkey AS ord, o_orderkey % 10 IN (1, 3, 5) AND o_orderstatus = 'F' AS hit, CASE WHEN o_orderkey % 10 IN (1, 3, 5) THEN 'confirmation' ELSE 'triage' END AS stage, 'index-' || (row_number() OVER (PARTITION BY o_orderkey // 16 ORDER BY o_orderkey) - 1) AS candidate_id FROM orders")
def two_stage_batches(spark, d):
    """Ads without ids in many batches: index-0 and so on mean another ad in each."""
    ads = t(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.lit(None).cast("string").alias("job_id"), F.col("o_orderkey").cast("string").alias("title"), F.when(F.col("o_orderstatus") == "F", "e").otherwise("x").alias("company"), F.lit("").alias("location"), F.lit("").alias("description"), F.lit("").alias("requirements_text"), F.lit(True).alias("prefilter_pass"), F.lit(None).cast("string").alias("prefilter_reason"))
    return evaluate.two_stage(ads, RuleProvider(), "profile", lambda df, stage: df, batch_size=16).select("ord", "hit", "stage", "candidate_id")


@query("SELECT vec_id AS ord, CASE WHEN label % 2 = 0 THEN 'hits' ELSE 'discard' END AS bucket FROM embeddings")
def routing_blank_ads(spark, d):
    """Ads without any text are routed like others."""
    rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), *(F.lit(None).cast("string").alias(c) for c in ("job_id", "title", "description")), "label")
    return evaluate.routed(rows.drop("label"), rows.select("ord", (F.col("label") % 2 == 0).alias("hit"))).select("ord", "bucket")


@query("SELECT 'rule' AS matcher, '2024-01-01T00:00:00Z' AS matched_at, count(*) AS job_count, count(*) FILTER (toxic = 1) AS hits_count, count(*) FILTER (toxic IS DISTINCT FROM 1) AS discards_count FROM labels")
def run_counts(spark, d):
    rows = t(spark, d, "labels").select((F.col("toxic") == 1).alias("hit"))
    return evaluate.run_metadata(rows, {"matcher": "rule", "matched_at": "2024-01-01T00:00:00Z"}).select("matcher", "matched_at", "job_count", "hits_count", "discards_count")


@query("SELECT count(*) > 0 AND bool_and(toxic = 1) AS ok FROM labels WHERE doc_id = (SELECT min(doc_id) FROM labels WHERE toxic = 1)")
def sentinel_assert(spark, d):
    rows = t(spark, d, "labels").where("toxic = 1").orderBy("doc_id").limit(1)
    return evaluate.assert_sentinel(rows.select(F.lit("sentinel-ad").alias("job_id"), F.lit("llm").alias("matcher"), (F.col("toxic") == 1).alias("hit")), "sentinel-ad", "llm")


@query("SELECT p_partkey, upper(left(p_name, 1)) IN ('A', 'E', 'I', 'O', 'U') AS hit FROM part")
def title_vowel(spark, d):
    return t(spark, d, "part").select("p_partkey", evaluate.title_vowel("p_name").alias("hit"))


_HEAD = "CASE p_size % 5 WHEN 0 THEN 'Requirements:' WHEN 1 THEN 'We offer you ' || p_size WHEN 2 THEN '  ABOUT YOU -' WHEN 3 THEN 'Requirements are many.' ELSE p_name END"


@query("SELECT p_partkey, p_size % 5 IN (0, 2) AS starts, p_size % 5 IN (1, 2) AS stops FROM part")
def heading_flags(spark, d):
    """No name of a part is a heading (its rows come from the names themselves)."""
    rows = t(spark, d, "part").select("p_partkey", F.expr(_HEAD).alias("line"))
    return rows.select("p_partkey", sections.is_heading(F.col("line"), sections.START_HEADINGS).alias("starts"), sections.is_heading(F.col("line"), sections.STOP_HEADINGS).alias("stops"))
