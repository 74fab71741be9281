"""Decision providers: a service that answers with JSON by schema, and the registry that programs choose from.

A provider travels to executors; its key is sent with it, never written. post(url, payload, headers) may be any client.
"""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable

from ..functions import driver_text, jsonx
from .evaluate import BASE_TOKENS, MAX_TOKENS, MIN_TOKENS, TOKENS_EACH, Provider, Reply

Post = Callable[[str, dict, dict], dict]

# The service's address and the settings of its calls.
URL = "https://api.openai.com/v1/responses"
EFFORT = VERBOSITY = "low"
DEFAULT_MODEL = "gpt-5.4-mini"
MATCH_TOKENS, RETRY_TOKENS = 512, 4096
TIMEOUT = 30


def post_json(url: str, payload: dict, headers: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:  # noqa: S310
            return json.loads(reply.read())
    except urllib.error.HTTPError as e:
        raise ValueError(f"the service answered {e.code}: {e.read().decode('utf-8', 'replace')}") from e
    except urllib.error.URLError as e:
        raise ValueError(f"the service cannot be reached: {e.reason}") from e


def cache_key(profile: str) -> str:
    """The same key as evaluate.profile_key."""
    return "job-profile:" + hashlib.sha256(profile.encode()).hexdigest()[:16]


def ad_lines(ad: dict) -> str:
    """'Label: value' lines, as evaluate.ad_text makes them."""
    return "\n".join(f"{c.title()}: {ad[c]}" for c in ("title", "company", "location", "description") if isinstance(ad.get(c), str) and ad[c].strip())


class Service:
    """Answers by calls that force a JSON schema; one retry with twice the tokens where a call ended at its limit without text."""

    name = "openai"

    def __init__(self, key: str, model: str = DEFAULT_MODEL, post: Post = post_json, url: str = URL):
        if not key:
            raise ValueError("the service needs a key")
        self.key, self.model, self.post, self.url = key, model, post, url

    def ask(self, prompt: str, name: str, schema: dict, tokens: int = MATCH_TOKENS, cache: str | None = None) -> Reply:
        answer_format = {"type": "json_schema", "name": name, "strict": True, "schema": schema}
        payload = {"model": self.model, "input": prompt, "reasoning": {"effort": EFFORT}, "text": {"verbosity": VERBOSITY, "format": answer_format}} | ({"prompt_cache_key": cache} if cache else {})
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        limits = [tokens] + [min(2 * tokens, RETRY_TOKENS)] * (tokens < RETRY_TOKENS)
        for limit in limits:
            body = self.post(self.url, payload | {"max_output_tokens": limit}, headers)
            if text := jsonx.text_of_response(body):
                usage = jsonx.response_usage(body)
                return Reply(text, json.dumps(usage) if usage is not None else None, body.get("model") or self.model)
            if (body.get("incomplete_details") or {}).get("reason") != "max_output_tokens":
                break
        raise ValueError(f"the service gave no text: {jsonx.response_shape(body)}")

    def triage(self, ads: list[dict], profile: str) -> Reply:
        tokens = min(MAX_TOKENS, max(MIN_TOKENS, BASE_TOKENS + TOKENS_EACH * len(ads)))
        return self.ask(driver_text.triage_prompt(json.dumps(ads, ensure_ascii=False), profile), "job_triage", jsonx.TRIAGE_SCHEMA, tokens, cache_key(profile))

    def confirm(self, ad: dict, profile: str) -> Reply:
        return self.ask(driver_text.confirmation_prompt(ad_lines(ad), profile), "job_match", jsonx.MATCH_SCHEMA, cache=cache_key(profile))

    def title_vowel(self, ad: dict) -> Reply:
        return self.ask(driver_text.title_vowel_prompt(ad.get("title")), "job_title_vowel", jsonx.MATCH_SCHEMA)

    def matches_title_vowel(self, ad: dict) -> bool:
        return jsonx.parse_hit(self.title_vowel(ad).text)


def named(matcher: str, key: str | None = None, model: str | None = None, post: Post = post_json) -> Provider | None:
    """The provider of a matcher; None for 'mock', which evaluate.mock_decisions decides without one."""
    if matcher == "mock":
        return None
    if matcher != Service.name:
        raise ValueError(f"no such matcher: {matcher}")
    return Service(key or os.environ.get("OPENAI_API_KEY", ""), model or DEFAULT_MODEL, post)
