"""Model providers as plain callables ``generate(prompt, json_schema) -> text``, to be run on executors.

A provider is a line of a table: where it is, what it is sent, and where its answer lies. The transport is a callable as
well, so that nothing here needs a network: ``post(url, payload, headers, timeout)`` gives the decoded JSON answer.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from ..schema import strict_schema

Post = Callable[[str, dict, dict, "float | None"], dict]


def post_json(url: str, payload: dict, headers: dict, timeout: float | None) -> dict:
    """One POST over the standard library's client; statuses other than success raise."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, **({} if timeout is None else {"timeout": timeout})) as answer:
        return json.load(answer)


@dataclass(frozen=True)
class Request:
    """All that a call needs but the prompt and the schema."""

    model: str
    base_url: str
    api_key: str | None = None
    think: bool = False
    options: dict[str, Any] = field(default_factory=dict)


def _chat(r: Request, prompt: str, schema: dict | None) -> tuple[str, dict, dict]:
    body = {"model": r.model, "messages": [{"role": "user", "content": prompt}], **r.options}
    if schema:
        body["response_format"] = {"type": "json_schema", "json_schema": {"name": schema.get("title", "record"), "strict": True, "schema": strict_schema(schema)}}
    return r.base_url + "/chat/completions", body, {"Authorization": f"Bearer {r.api_key}"} if r.api_key else {}


def _chat_answer(data: dict) -> str:
    message = (data.get("choices") or [{}])[0].get("message") or {}
    if message.get("refusal"):
        raise RuntimeError(message["refusal"])
    if not message.get("content"):
        raise RuntimeError(f"the model gave no content: {data}")
    return message["content"]


def _content(r: Request, prompt: str, schema: dict | None) -> tuple[str, dict, dict]:
    shape = {"responseMimeType": "application/json", "responseSchema": schema} if schema else {}
    config = r.options | shape
    body = {"contents": [{"parts": [{"text": prompt}]}], **({"generationConfig": config} if config else {})}
    return f"{r.base_url}/models/{r.model}:generateContent", body, {"x-goog-api-key": r.api_key or ""}


def _local(r: Request, prompt: str, schema: dict | None) -> tuple[str, dict, dict]:
    body = {"model": r.model, "prompt": prompt, "stream": False, "think": r.think}
    return r.base_url + "/api/generate", body | ({"options": r.options} if r.options else {}) | ({"format": schema} if schema else {}), {}


@dataclass(frozen=True)
class Provider:
    base_url: str
    #: Whether a key is needed: always, never, or only at the provider's own address.
    key: str
    options: frozenset[str]
    ask: Callable[[Request, str, dict | None], tuple[str, dict, dict]]
    answer: Callable[[dict], str]


# The public interfaces of the providers and the options they take.
PROVIDERS = {
    "ollama": Provider("http://localhost:11434", "never", frozenset("num_ctx num_predict temperature top_p repeat_penalty".split()), _local, lambda data: data["response"]),
    "google": Provider("https://generativelanguage.googleapis.com/v1beta", "always", frozenset("temperature topP maxOutputTokens responseMimeType responseSchema".split()), _content, lambda data: data["candidates"][0]["content"]["parts"][0]["text"]),
    "openai": Provider("https://api.openai.com/v1", "own", frozenset("temperature max_tokens top_p response_format".split()), _chat, _chat_answer),
}
PROVIDERS["gemini"] = PROVIDERS["google"]


def _generate(provider: str, request: Request, timeout: float | None, post: Post, prompt: str, schema: dict | None = None) -> str:
    p = PROVIDERS[provider]
    return p.answer(post(*p.ask(request, prompt, schema), timeout))


def model(provider: str, model_name: str, api_key: str | None = None, base_url: str | None = None, timeout: float | None = None, options: dict[str, Any] | None = None, strict: bool = True, think: bool = False, post: Post = post_json) -> Callable[..., str]:
    """A callable for ``LLMSettings.generate``. With ``strict`` options that a provider doesn't know are left out.

    A key is needed for Google's, and for OpenAI's own address but not for servers that speak like it.
    """
    name = provider.lower()
    if name not in PROVIDERS:
        raise ValueError(f"provider must be one of {sorted(PROVIDERS)}, not {provider!r}")
    p = PROVIDERS[name]
    if not api_key and (p.key == "always" or p.key == "own" and not base_url):
        raise ValueError(f"{name} needs an api_key")
    known = {k: v for k, v in (options or {}).items() if not strict or k in p.options}
    return partial(_generate, name, Request(model_name, (base_url or p.base_url).rstrip("/"), api_key, think, known), timeout, post)
