"""Review by a language model: settings, an HTTP provider with a fallback model, the text of its answers, a cache."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of yes, and keys that stand for none.
YES, NO_KEY = ("1", "true", "yes", "on"), ("", "your_api_key", "changeme", "none")
ACTIONS, CONFIDENCES = ("save_alias", "ignore", "move_to_ambiguous", "skip"), ("low", "medium", "high")


class ReviewError(RuntimeError):
    """The provider gave no usable answer."""


@dataclass(frozen=True)
class ReviewConfig:
    enabled: bool = False
    url: str = ""
    key: str = ""
    model: str = ""
    fallback: str = ""
    most: int = 20

    @classmethod
    def from_env(cls, env=os.environ) -> ReviewConfig:
        get = lambda name, default="": env.get(f"STRANDLINE_REVIEW_{name}", default).strip()
        return cls(get("ENABLED").lower() in YES, get("URL"), get("KEY"), get("MODEL"), get("FALLBACK"), int(get("MOST", "20") or 20))

    @property
    def usable(self) -> bool:
        return self.enabled and bool(self.url and self.model) and self.key.lower() not in NO_KEY


def answer_text(response: dict) -> str:
    """The text of an answer: output_text, or the text parts of its output items."""
    if response.get("output_text"):
        return response["output_text"]
    parts = [c.get("text", "") for item in response.get("output", []) for c in item.get("content", []) if c.get("type") in ("output_text", "text")]
    if not any(parts):
        raise ReviewError("the answer has no text")
    return "".join(parts)


def answer_text_column(response: Column) -> Column:
    """answer_text() of a JSON column."""
    kind = "struct<output_text:string,output:array<struct<content:array<struct<type:string,text:string>>>>>"
    r = F.from_json(response, kind)
    texts = F.transform(F.filter(F.flatten(F.transform(r["output"], lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>")))), lambda c: c["type"].isin("output_text", "text")), lambda c: c["text"])
    return F.coalesce(F.nullif(r["output_text"], F.lit("")), F.nullif(F.array_join(texts, ""), F.lit("")))


def reviews_of(text: str, canonicals: set[str]) -> list[dict]:
    """The valid reviews in an answer's JSON text; one that saves an alias must name a known canonical."""
    try:
        rows = json.loads(text)["reviews"]
    except (ValueError, KeyError, TypeError) as e:
        raise ReviewError(f"the answer is not a list of reviews: {e}") from e
    good = lambda r: r.get("recommendation") in ACTIONS and r.get("confidence") in CONFIDENCES and (r["recommendation"] != "save_alias" or r.get("canonical_name") in canonicals)
    return [r for r in rows if isinstance(r, dict) and good(r)]


def cache_key(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def _post(url: str, key: str, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})  # noqa: S310
    with urllib.request.urlopen(request, timeout=120) as r:  # noqa: S310
        return json.loads(r.read())


def provider(config: ReviewConfig, canonicals: set[str], post=_post):
    """A callable payload -> reviews. The fallback model is asked where the first fails; without usable settings nothing is."""
    if not config.usable:
        return lambda payload: []

    def ask(payload: dict) -> list[dict]:
        said = None
        for model in dict.fromkeys(m for m in (config.model, config.fallback) if m):
            try:
                task = "For each row decide whether raw_value is a name of canonical_name. Answer with JSON: {\"reviews\": [{review_id, recommendation, canonical_name, confidence, reason}]}."
                return reviews_of(answer_text(post(config.url, config.key, {"model": model, "instructions": task, "input": json.dumps(payload, ensure_ascii=False)})), canonicals)
            except (ReviewError, OSError, ValueError) as e:
                said = e
        raise ReviewError(f"no model answered: {said}")

    return ask
