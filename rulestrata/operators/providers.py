"""The judges' providers: which one a key belongs to, its models, the form of a request and of an
answer, and a client that any transport can be put behind."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

#: Beginnings of keys, tried in order, and models by provider and size: fixed values.
PREFIXES = [("sk-ant-", "anthropic"), ("sk-", "openai")]
OTHER = "gemini"
MODELS = {
    "anthropic": {"small": "claude-haiku-4-5", "large": "claude-sonnet-4-5"},
    "openai": {"small": "gpt-4o-mini", "large": "gpt-4o"},
    "gemini": {"small": "gemini-1.5-flash", "large": "gemini-1.5-pro"},
}
#: Tokens that a verdict may take, and that any other call may take.
VERDICT_TOKENS, CALL_TOKENS = 512, 1024


def provider_of(key: str) -> str:
    return next((name for start, name in PREFIXES if key.startswith(start)), OTHER)


@dataclass(frozen=True)
class Request:
    url: str
    headers: dict[str, str]
    body: dict


#: (request) to (status, body text): whatever reaches the provider.
Transport = Callable[[Request], tuple[int, str]]


def request(provider: str, key: str, model: str, system: str, user: str, max_tokens: int = CALL_TOKENS) -> Request:
    """A provider's public form of one question."""
    plain = {"Content-Type": "application/json"}
    if provider == "anthropic":
        said = [{"role": "user", "content": user}]
        return Request("https://api.anthropic.com/v1/messages", plain | {"x-api-key": key, "anthropic-version": "2023-06-01"}, {"model": model, "max_tokens": max_tokens, "system": system, "messages": said})
    if provider == "openai":
        said = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        return Request("https://api.openai.com/v1/chat/completions", plain | {"Authorization": f"Bearer {key}"}, {"model": model, "max_tokens": max_tokens, "temperature": 0, "messages": said, "response_format": {"type": "json_object"}})
    limits = {"maxOutputTokens": max_tokens, "temperature": 0, "responseMimeType": "application/json"}
    return Request(f"https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent?key={key}", plain, {"systemInstruction": {"parts": [{"text": system}]}, "contents": [{"parts": [{"text": user}]}], "generationConfig": limits})


def _at(value, *keys):
    for k in keys:
        try:
            value = value[k]
        except (KeyError, IndexError, TypeError):
            return None
    return value


#: Where a provider's answer has its text and the tokens that went in and came out.
_PLACES = {
    "anthropic": (("content", 0, "text"), ("usage", "input_tokens"), ("usage", "output_tokens")),
    "openai": (("choices", 0, "message", "content"), ("usage", "prompt_tokens"), ("usage", "completion_tokens")),
    "gemini": (("candidates", 0, "content", "parts", 0, "text"), ("usageMetadata", "promptTokenCount"), ("usageMetadata", "candidatesTokenCount")),
}


def answer(provider: str, status: int, body: str) -> tuple[str, int, int]:
    """The text of an answer and its tokens. Another status than 2xx, and an answer of the first
    provider without a text, are errors; the others' are then empty texts."""
    if not 200 <= status < 300:
        raise RuntimeError(f"{provider} API error: {status} {body}")
    data = json.loads(body)
    text, tokens_in, tokens_out = (_at(data, *place) for place in _PLACES[provider])
    if provider == "anthropic" and (_at(data, "content", 0, "type") != "text" or text is None):
        raise RuntimeError("No text content in LLM response")
    return text or "", int(tokens_in or 0), int(tokens_out or 0)


def over_https(r: Request) -> tuple[int, str]:
    """The transport of a run with a network."""
    sent = urllib.request.Request(r.url, json.dumps(r.body).encode(), r.headers, method="POST")
    try:
        with urllib.request.urlopen(sent, timeout=120) as got:  # noqa: S310
            return got.status, got.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


@dataclass(frozen=True)
class Client:
    """A judge: ``client(prompt, size)`` is the answer's text and tokens. ``model``, if given, takes
    the place of the routed one. The prompt's head ``system`` goes as the system's message."""

    key: str
    transport: Transport = over_https
    model: str | None = None
    max_tokens: int = VERDICT_TOKENS
    system: str = ""

    def model_of(self, size: str) -> str:
        return self.model or MODELS[provider_of(self.key)].get(size, size)

    def __call__(self, prompt: str, size: str = "small") -> tuple[str, int, int]:
        of = provider_of(self.key)
        user = prompt.removeprefix(self.system).lstrip("\n") if self.system else prompt
        return answer(of, *self.transport(request(of, self.key, self.model_of(size), self.system, user, self.max_tokens)))
