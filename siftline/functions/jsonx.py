"""Loosely typed JSON: ids at any depth, service responses, strict decision parsing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textx import col, strip

# The schemas that answers are held to.
MATCH_SCHEMA = {"type": "object", "properties": {"hit": {"type": "boolean"}, "reason": {"type": "string"}}, "required": ["hit", "reason"], "additionalProperties": False}
TRIAGE_SCHEMA = {
    "type": "object",
    "properties": {"candidates": {"type": "array", "items": {"type": "object", "properties": {"candidate_id": {"type": "string"}, "reason": {"type": "string"}}, "required": ["candidate_id", "reason"], "additionalProperties": False}}},
    "required": ["candidates"],
    "additionalProperties": False,
}


def collect_ids(payload, key: str = "job_id") -> list[str]:
    """Every value of key at any depth that is not null or '', as text; descends into values too."""
    found: list[str] = []
    todo = [payload]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if node.get(key) not in (None, ""):
                found.append(str(node[key]))
            todo.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            todo.extend(reversed(node))
    return found


def _ids_of(text: str | None, key: str) -> list[str]:
    try:
        return collect_ids(json.loads(text), key) if text else []
    except ValueError:
        return []


def ids_udf(key: str = "job_id"):
    """array<string> of the ids in a JSON text; unreadable texts have none. For many or deep files."""
    return F.pandas_udf(lambda column: pd.Series([_ids_of(x, key) for x in column]), T.ArrayType(T.StringType()))


def ids_recursive(spark: SparkSession, texts: DataFrame, text: str, key: str = "job_id") -> DataFrame:
    """The same ids by a recursive query over variants, all in the JVM: (id). Depth is bounded by Spark's recursion limit."""
    texts.select(F.expr(f"try_parse_json({text})").alias("v")).createOrReplaceTempView("__ids_source")
    return spark.sql(
        f"""WITH RECURSIVE w(v) AS (SELECT v FROM __ids_source WHERE v IS NOT NULL
              UNION ALL SELECT e.value FROM w, LATERAL variant_explode(w.v) e WHERE schema_of_variant(w.v) LIKE 'OBJECT%' OR schema_of_variant(w.v) LIKE 'ARRAY%')
            SELECT try_variant_get(v, '$.{key}', 'string') AS id FROM w
            WHERE schema_of_variant(v) LIKE 'OBJECT%' AND try_variant_get(v, '$.{key}', 'string') <> ''"""
    )


def response_text(body: str | Column) -> Column:
    """output_text if it is text, else the nested texts one after the other."""
    v = F.try_parse_json(col(body))
    top = F.when(F.schema_of_variant(F.try_variant_get(v, "$.output_text", "variant")) == "STRING", F.try_variant_get(v, "$.output_text", "string"))
    items = F.from_json(F.get_json_object(col(body), "$.output"), "array<struct<content:array<struct<type:string,text:string>>>>")
    parts = F.flatten(F.transform(F.coalesce(items, F.array()), lambda i: F.coalesce(i["content"], F.array())))
    nested = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "")
    return F.coalesce(top, nested, F.lit(""))


def parsed_match(text: str | Column) -> Column:
    """struct(hit, reason, error): hit must be a boolean and reason not blank, or else error says why."""
    v = F.try_parse_json(col(text))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    hit_ok = F.coalesce(kind("$.hit") == "BOOLEAN", F.lit(False))
    reason = F.when(kind("$.reason") == "STRING", strip(F.try_variant_get(v, "$.reason", "string")))
    error = F.when(v.isNull(), "not JSON").when(~hit_ok, "hit is not a boolean").when(F.coalesce(reason, F.lit("")) == "", "reason is blank")
    return F.struct(F.when(error.isNull(), F.try_variant_get(v, "$.hit", "boolean")).alias("hit"), F.when(error.isNull(), reason).alias("reason"), error.alias("error"))


def strict_match(text: str | Column) -> Column:
    """parsed_match that fails the query on a bad response."""
    parsed = parsed_match(text)
    return F.when(parsed["error"].isNull(), F.struct(parsed["hit"].alias("hit"), parsed["reason"].alias("reason"))).otherwise(F.raise_error(F.concat(F.lit("bad decision: "), parsed["error"])).cast("struct<hit:boolean,reason:string>"))


def parse_triage(text: str, valid: set[str]) -> dict[str, str]:
    """candidate id -> reason in order. One bad candidate fails the whole batch; later duplicates are dropped."""
    found = json.loads(text)
    if not isinstance(found, dict) or not isinstance(found.get("candidates"), list):
        raise ValueError("triage response needs a candidates array")
    out: dict[str, str] = {}
    for c in found["candidates"]:
        own, reason = (c.get("candidate_id"), c.get("reason")) if isinstance(c, dict) else (None, None)
        if not isinstance(own, str) or own not in valid or not isinstance(reason, str) or not reason.strip():
            raise ValueError(f"bad triage candidate: {c!r}")
        out.setdefault(own, reason.strip())
    return out


def parse_hit(text: str) -> bool:
    found = json.loads(text)
    hit = found.get("hit") if isinstance(found, dict) else None
    if not isinstance(hit, bool):
        raise ValueError("hit must be a boolean")
    return hit


def _items(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def text_of_response(body: dict) -> str:
    """The same text as response_text, of one response on a worker."""
    if isinstance(body.get("output_text"), str):
        return body["output_text"]
    return "".join(part["text"] for item in _items(body.get("output")) for part in _items(item.get("content")) if isinstance(part.get("text"), str))


def response_shape(body: dict) -> str:
    """A short description of a response without its texts, for error messages."""
    return json.dumps({c: body.get(c) for c in ("id", "status", "model", "incomplete_details", "error")} | {"output_types": [i.get("type") for i in _items(body.get("output"))]}, ensure_ascii=False)


def response_usage(body: dict) -> dict | None:
    return body["usage"] if isinstance(body.get("usage"), dict) else None
