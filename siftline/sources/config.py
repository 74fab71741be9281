"""Search configuration: JSON with comments, aliases, several searches; small and read on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path
from urllib.parse import urlencode

from ..functions.driver_text import strip_comments, strip_trailing_commas, text_of

# Parameter names with the configuration keys that set them, in output order.
ALIASES = {
    "keywords": ("keywords", "search_terms", "query"), "location": ("location",), "geoId": ("geoId", "geo_id"), "distance": ("distance",),
    "f_TPR": ("f_TPR", "date_posted"), "f_E": ("f_E", "experience_levels"), "f_JT": ("f_JT", "job_types"), "f_WT": ("f_WT", "work_types"),
    "f_AL": ("f_AL", "easy_apply"), "f_EA": ("f_EA", "easy_apply_alt"), "f_JIYN": ("f_JIYN", "in_network"), "f_VJ": ("f_VJ", "verified_jobs"),
    "f_C": ("f_C", "company_ids"), "f_PP": ("f_PP", "place_ids"), "sortBy": ("sortBy", "sort_by"),
}
# The origin parameter, and parameters of which a search needs one.
ORIGIN = "JOB_SEARCH_PAGE_JOB_FILTER"
NEEDED = ("keywords", "location", "geoId", "f_PP")


def load(path: str) -> dict:
    found = json.loads(strip_trailing_commas(strip_comments(Path(path).read_text(encoding="utf-8"))))
    if not isinstance(found, dict):
        raise ValueError("the configuration must be an object")
    return found


def _given(value) -> bool:
    return value is not None and value != "" and value != []


def query_value(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return ",".join(map(str, value)) if isinstance(value, list) else str(value)


def search_url(config: Mapping, base: str) -> str:
    own = config.get("search_url")
    if isinstance(own, str) and own.strip():
        return own.strip()
    params = {"origin": ORIGIN}
    for name, keys in ALIASES.items():
        value = next((config[k] for k in keys if _given(config.get(k))), None)
        if value is not None:
            params[name] = query_value(value)
    extra = config.get("extra_params")
    params |= {str(k): query_value(v) for k, v in (extra if isinstance(extra, dict) else {}).items() if _given(v)}
    if not any(k in params for k in NEEDED):
        raise ValueError("a search needs search_url, keywords, location, geo_id or place_ids")
    return f"{base}?{urlencode(params)}"


def searches(config: Mapping) -> list[Mapping]:
    found = config.get("searches")
    if found is None or found == []:
        return [config]
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise ValueError("searches must be a list of objects")
    return found


def search_urls(config: Mapping, base: str) -> list[str]:
    return [search_url(c, base) for c in searches(config)]


def flag(value: str | None) -> bool:
    return (value or "").strip().lower() in ("1", "true", "yes", "on")


def profile(path: str) -> str:
    text = text_of(Path(path).read_text(encoding="utf-8"))
    if not text:
        raise ValueError("the profile is empty")
    return text


def sentinel_path(root: str, explicit: str | None = None) -> str:
    """Flag, then environment, then the default in the results folder."""
    return explicit or os.environ.get("SENTINEL_AD_PATH") or os.path.join(root, "sentinel_ad.rtf")


_LABELS = {"job title": "title", "company": "company", "location": "location", "posted": "posted", "url": "url", "job description": "description", "description": "description"}


def sentinel(path: str, today: str) -> dict[str, str]:
    """The sentinel ad: sections under label lines; title and description are required."""
    raw = Path(path).read_bytes()
    try:
        text = text_of(raw.decode("utf-8"))
    except UnicodeDecodeError:
        text = text_of(raw.decode("latin-1"))
    parts: dict[str, list[str]] = {}
    now = None
    for line in text.splitlines():
        label = _LABELS.get(line.strip().rstrip(":").lower())
        if label:
            now = parts.setdefault(label, [])
        elif now is not None and line.strip():
            now.append(line.strip())
    row = {k: ("\n" if k == "description" else " ").join(v) for k, v in parts.items()}
    if not row.get("title") or not row.get("description"):
        raise ValueError("the sentinel ad needs a title and a description")
    return {"job_id": "sentinel-ad", "posted": "Today", "posted_date": today} | row


def limits(card_limit: int | None = None, detail_limit: int | None = None, limit: int | None = None) -> tuple[int, int]:
    """(cards to keep, details to read): each flag falls back to the one before it; limit to JOB_SEARCH_LIMIT, then 2."""
    cards = next(x for x in (card_limit, limit, int(os.environ.get("JOB_SEARCH_LIMIT", "2"))) if x is not None)
    return cards, max(cards if detail_limit is None else detail_limit, 0)
