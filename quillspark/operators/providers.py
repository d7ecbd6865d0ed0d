"""Hosted and local model providers, over plain HTTP.

``post(url, payload, headers) -> (status, body)`` is the only contact with the
network, so every provider runs offline in tests.
"""

import json
import os
import time
import urllib.error
import urllib.request

from pyspark.sql import SparkSession

from ..plans.agent import Turn
from .classify import ProviderError, items_message, parse_reply

GEMINI = "https://generativelanguage.googleapis.com/v1beta/models/{}:generateContent"
OLLAMA = "http://localhost:11434"
ANTHROPIC = "https://api.anthropic.com/v1/messages"


def http_post(url: str, payload: dict, headers: dict, timeout: float = 120.0):
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, json.loads(reply.read())
    except urllib.error.HTTPError as e:
        return e.code, {"error": e.reason}
    except (OSError, ValueError) as e:
        raise ProviderError(type(e).__name__) from e


def _limited(status: int, body) -> bool:
    return status == 429 or "RESOURCE_EXHAUSTED" in json.dumps(body.get("error", "") if isinstance(body, dict) else "")


def call(post, url, payload, headers, retries: int = 3, base: float = 2.0, sleep=time.sleep) -> dict:
    """The body of a good reply. Rate limits are waited out: 1, 2, 4 ... times the base."""
    for attempt in range(retries + 1):
        status, body = post(url, payload, headers)
        if _limited(status, body) and attempt < retries:
            sleep(base * 2**attempt)
            continue
        if status >= 400 or not isinstance(body, dict):
            raise ProviderError(f"HTTP {status}")
        return body


def _dig(body, *path):
    """A nested value; ProviderError where the reply has another shape."""
    for step in path:
        try:
            body = body[step]
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError("unexpected reply shape") from e
    return body


class _Classifier:
    """Replies are asked for on any machine; reading one as rows takes a session."""

    def __getstate__(self):
        return self.__dict__ | {"spark": None}

    def classify(self, prompt, items, temperature):
        return parse_reply(self.spark, self.ask(prompt, items, temperature), [i["id"] for i in items])


class OllamaClassifier(_Classifier):
    def __init__(self, spark: SparkSession, model: str, base: str | None = None, post=http_post):
        self.spark, self.model, self.post = spark, model, post
        self.base, self.model_id = base or os.environ.get("OLLAMA_HOST", OLLAMA), f"ollama:{model}"

    def ask(self, prompt, items, temperature):
        payload = {"model": self.model, "stream": False, "format": "json", "options": {"temperature": temperature},
                   "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": items_message(items)}]}
        return _dig(call(self.post, f"{self.base}/api/chat", payload, {}, retries=0), "message", "content")


class GeminiClassifier(_Classifier):
    def __init__(self, spark: SparkSession, model: str, key: str, post=http_post, sleep=time.sleep):
        self.spark, self.model, self.key, self.post, self.sleep, self.model_id = spark, model, key, post, sleep, f"gemini:{model}"

    def ask(self, prompt, items, temperature):
        payload = {"systemInstruction": {"parts": [{"text": prompt}]}, "contents": [{"role": "user", "parts": [{"text": items_message(items)}]}],
                   "generationConfig": {"temperature": temperature, "responseMimeType": "application/json"}}
        body = call(self.post, GEMINI.format(self.model), payload, {"x-goog-api-key": self.key}, sleep=self.sleep)
        return "".join(p.get("text", "") for p in _dig(body, "candidates", 0, "content", "parts"))


def make_classifier(spark: SparkSession, provider: str, model: str, env=os.environ, **options):
    """The configured provider; None without its key. ``anthropic`` is for synthesis only."""
    if provider == "ollama":
        return OllamaClassifier(spark, model, **options)
    if provider == "gemini":
        key = env.get("GEMINI_API_KEY") or env.get("GOOGLE_API_KEY")
        return GeminiClassifier(spark, model, key, **options) if key else None
    raise ValueError(f"no classifier for provider {provider!r}")


# ------------------------------------------------------------------ agent turns


def anthropic_payload(model: str, system: str, messages: list[dict], tools: list[dict], max_tokens: int) -> dict:
    keep = {"text": ("type", "text"), "tool_use": ("type", "id", "name", "input"), "tool_result": ("type", "tool_use_id", "content")}
    turns = [{"role": m["role"], "content": [{k: b[k] for k in keep[b["type"]]} for b in m["content"]]} for m in messages if m["content"]]
    return {"model": model, "max_tokens": max_tokens, "system": system, "messages": turns, "tools": tools}


def anthropic_turn(body: dict) -> Turn:
    blocks, usage = _dig(body, "content"), body.get("usage") or {}
    text = "".join(b["text"] for b in blocks if b.get("type") == "text")
    calls = [(b["id"], b["name"], b.get("input") or {}) for b in blocks if b.get("type") == "tool_use"]
    return Turn(text or None, calls, (usage.get("input_tokens", 0), usage.get("output_tokens", 0)))


def gemini_payload(system: str, messages: list[dict], tools: list[dict]) -> dict:
    def part(b):
        if b["type"] == "text":
            return {"text": b["text"]}
        if b["type"] == "tool_use":
            return {"functionCall": {"name": b["name"], "args": b["input"]}}
        return {"functionResponse": {"name": b["name"], "response": json.loads(b["content"])}}

    def schema(s):
        return {k: schema(v) if isinstance(v, dict) else v for k, v in s.items() if k != "additionalProperties"}

    declared = [{"name": t["name"], "description": t["description"], "parameters": schema(t["input_schema"])} for t in tools]
    contents = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [part(b) for b in m["content"]]} for m in messages if m["content"]]
    return {"systemInstruction": {"parts": [{"text": system}]}, "contents": contents, "tools": [{"functionDeclarations": declared}]}


def gemini_turn(body: dict) -> Turn:
    parts, usage = _dig(body, "candidates", 0, "content").get("parts") or [], body.get("usageMetadata") or {}
    calls = [(f"call-{k}", p["functionCall"]["name"], p["functionCall"].get("args") or {}) for k, p in enumerate(parts) if "functionCall" in p]
    text = "".join(p.get("text", "") for p in parts)
    return Turn(text or None, calls, (usage.get("promptTokenCount", 0), usage.get("candidatesTokenCount", 0)))


class AnthropicAgent:
    def __init__(self, key: str, model: str, max_tokens: int = 4096, post=http_post, sleep=time.sleep):
        self.key, self.model, self.max_tokens, self.post, self.sleep, self.model_id = key, model, max_tokens, post, sleep, f"anthropic:{model}"

    def complete(self, system, messages, tools):
        headers = {"x-api-key": self.key, "anthropic-version": "2023-06-01"}
        return anthropic_turn(call(self.post, ANTHROPIC, anthropic_payload(self.model, system, messages, tools, self.max_tokens), headers, sleep=self.sleep))


class GeminiAgent:
    def __init__(self, key: str, model: str, post=http_post, sleep=time.sleep):
        self.key, self.model, self.post, self.sleep, self.model_id = key, model, post, sleep, f"gemini:{model}"

    def complete(self, system, messages, tools):
        return gemini_turn(call(self.post, GEMINI.format(self.model), gemini_payload(system, messages, tools), {"x-goog-api-key": self.key}, sleep=self.sleep))


def make_agent(env=os.environ, **options):
    """The first provider that has a key; None without any."""
    if key := env.get("ANTHROPIC_API_KEY"):
        return AnthropicAgent(key, env.get("SYNTHESIS_MODEL", "claude-sonnet-4-5"), **options)
    if key := env.get("GEMINI_API_KEY") or env.get("GOOGLE_API_KEY"):
        return GeminiAgent(key, env.get("SYNTHESIS_MODEL", "gemini-2.5-flash"), **options)
    return None
