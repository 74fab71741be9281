"""URL expressions: query parameters, search labels, and the same encoding as application/x-www-form-urlencoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textx import col

GEO_ONLY = "geo-only"
# Parameters that a captured search page may keep; start is set by the pager.
PAGE_PARAMS = ("keywords", "location", "geoId", "distance", "f_TPR", "f_E", "f_JT", "f_WT", "f_AL", "f_EA", "f_JIYN", "f_VJ", "f_C", "f_PP", "sortBy")


def query_pairs(url: str | Column) -> Column:
    """Array of (name, value) of the non-blank query parameters, in order, decoded."""
    raw = F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(raw, "&"), lambda p: p.rlike("^[^=]*=.")), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("name"), F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))
    return pairs


def query_param(url: str | Column, name: str) -> Column:
    """The last non-blank value of a parameter; null without one."""
    return F.try_element_at(F.filter(query_pairs(url), lambda p: p["name"] == name), F.lit(-1))["value"]


def search_label(url: str | Column) -> Column:
    return F.coalesce(query_param(url, "keywords"), F.when(query_param(url, "geoId").isNotNull(), GEO_ONLY), col(url))


def is_geo_only(label: str | Column) -> Column:
    return F.coalesce((col(label) == GEO_ONLY) | col(label).startswith("geoId="), F.lit(False))


def form_encode(c: str | Column) -> Column:
    """Percent-encoding in which a space is '+', '~' stays and '*' does not."""
    return F.replace(F.replace(F.url_encode(col(c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def build_query(params: dict[str, Column]) -> Column:
    """name=value pairs of the values that are not null or '', in order."""
    return F.concat_ws("&", *(F.when(v != "", F.concat(F.lit(f"{name}="), form_encode(v))) for name, v in params.items()))


def page_url(base: str, url: str | Column, start: Column) -> Column:
    """The paged endpoint for a search url: allow-listed parameters (last of a name wins), then start."""
    return F.concat(F.lit(f"{base}?"), build_query({n: query_param(url, n) for n in PAGE_PARAMS} | {"start": start.cast("string")}))


def detail_url(base: str, job_id: str | Column) -> Column:
    return F.concat(F.lit(f"{base}/"), col(job_id))
