"""Clients of embedding and chat services, and the factory that makes them from a configuration.

A client is small and can be sent to executors. All of them speak through `send`, a function from URL, headers
and body to the answer, so that tests (and other transports) need no network. 401 and 403 become AuthError.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import numpy as np

from ..functions.text import DEFAULT_PROMPT, EMBEDDING_INPUT, FULL_DIMENSION
from ..sources.files import Provider
from .providers import AuthError, Contextualizer, Embedder, HashingEmbedder, NullContextualizer, NullEmbedder

Send = Callable[[str, dict, dict], dict]
SECONDS = 600
MAX_TOKENS = 500
# Where the services answer unless a configuration says otherwise.
PLACES = {"ollama": "http://localhost:11434", "openai": "https://api.openai.com", "gemini": "https://generativelanguage.googleapis.com/v1beta", "anthropic": "https://api.anthropic.com"}
KEEP_ALIVE, CONTEXT_LENGTH = "5m", 8192


def post(url: str, headers: dict, body: dict) -> dict:
    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urlopen(request, timeout=SECONDS) as answer:
            return json.load(answer)
    except HTTPError as e:
        said = e.read(500).decode("utf-8", "replace")
        raise (AuthError if e.code in (401, 403) else RuntimeError)(f"HTTP {e.code}: {said}") from None


def bearer(key: str) -> dict:
    return {"Authorization": f"Bearer {key}"} if key else {}


def in_order(items: list[dict]) -> list[dict]:
    """Items of a batch answer, which may come in any order, by their index."""
    return sorted(items, key=lambda x: x["index"])


def unit(v: list[float]) -> list[float]:
    """Scaled to length 1 if shorter than the full dimension and not almost zero."""
    n = float(np.linalg.norm(v))
    return v if len(v) >= FULL_DIMENSION or n < 1e-12 else (np.asarray(v) / n).tolist()


@dataclass
class Client:
    base: str
    model: str
    key: str = field(default="", repr=False)
    dimension: int = 0
    keep_alive: str = KEEP_ALIVE
    context_length: int = CONTEXT_LENGTH
    system: str = DEFAULT_PROMPT
    send: Send = post

    def call(self, path: str, body: dict, headers: dict | None = None) -> dict:
        return self.send(f"{self.base.rstrip('/')}{path}", headers or {}, body)

    def embed_query(self, text: str) -> list[float]:
        return self.embed([text])[0]


class OpenAIEmbedder(Client):
    def embed(self, texts: list[str]) -> list[list[float]]:
        return [x["embedding"] for x in in_order(self.call("/v1/embeddings", {"model": self.model, "input": texts}, bearer(self.key))["data"])]


class OllamaEmbedder(Client):
    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.call("/api/embed", {"model": self.model, "input": texts, "keep_alive": self.keep_alive})["embeddings"]


class GeminiEmbedder(Client):
    """Documents and queries are embedded for different tasks; long inputs are cut, short vectors scaled."""

    input_chars = EMBEDDING_INPUT

    def _request(self, text: str, task: str) -> dict:
        size = {"outputDimensionality": self.dimension} if self.dimension > 0 else {}
        return {"model": f"models/{self.model}", "content": {"parts": [{"text": text[:EMBEDDING_INPUT]}]}, "taskType": task, **size}

    def _headers(self) -> dict:
        return {"x-goog-api-key": self.key}

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = {"requests": [self._request(t, "RETRIEVAL_DOCUMENT") for t in texts]}
        return [unit(x["values"]) for x in self.call(f"/models/{self.model}:batchEmbedContents", body, self._headers())["embeddings"]]

    def embed_query(self, text: str) -> list[float]:
        return unit(self.call(f"/models/{self.model}:embedContent", self._request(text, "RETRIEVAL_QUERY"), self._headers())["embedding"]["values"])


class AnthropicContextualizer(Client):
    def enrich(self, prompt: str) -> str:
        body = {"model": self.model, "max_tokens": MAX_TOKENS, "system": self.system, "messages": [{"role": "user", "content": prompt}]}
        return self.call("/v1/messages", body, {"x-api-key": self.key, "anthropic-version": "2023-06-01"})["content"][0]["text"]


class _Chat(Client):
    def messages(self, prompt: str) -> list[dict]:
        return [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]


class OpenAIContextualizer(_Chat):
    def enrich(self, prompt: str) -> str:
        body = {"model": self.model, "messages": self.messages(prompt), "temperature": 0.0, "max_tokens": MAX_TOKENS}
        return self.call("/v1/chat/completions", body, bearer(self.key))["choices"][0]["message"]["content"]


class OllamaContextualizer(_Chat):
    def enrich(self, prompt: str) -> str:
        body = {"model": self.model, "messages": self.messages(prompt), "stream": False, "keep_alive": self.keep_alive, "options": {"num_ctx": self.context_length}}
        return self.call("/api/chat", body)["message"]["content"]


def _hashing(**given) -> Embedder:
    return HashingEmbedder(given["dimension"] or 64, given["model"])


#: What a configuration may name; register() adds more.
EMBEDDERS: dict[str, Callable[..., Embedder]] = {"openai": OpenAIEmbedder, "ollama": OllamaEmbedder, "gemini": GeminiEmbedder, "hashing": _hashing}
CONTEXTUALIZERS: dict[str, Callable[..., Contextualizer]] = {"anthropic": AnthropicContextualizer, "openai": OpenAIContextualizer, "ollama": OllamaContextualizer}


def register(name: str, embedder: Callable[..., Embedder] | None = None, contextualizer: Callable[..., Contextualizer] | None = None) -> None:
    if embedder:
        EMBEDDERS[name.lower()] = embedder
    if contextualizer:
        CONTEXTUALIZERS[name.lower()] = contextualizer


def _made(known: dict[str, Callable], config: Provider, more: dict):
    name = config.provider.lower()
    if name not in known:
        raise ValueError(f"Unknown provider '{config.provider}'")
    return known[name](base=config.baseUrl or PLACES.get(name, PLACES["ollama"]), model=config.model, dimension=config.dimension, keep_alive=config.keepAlive or KEEP_ALIVE, context_length=config.numCtx or CONTEXT_LENGTH, **more)


def embedder_of(config: Provider, key: str = "", **more) -> Embedder:
    """Without a model the null embedder; ValueError for a provider nobody registered."""
    return _made(EMBEDDERS, config, {"key": key, **more}) if config.model.strip() else NullEmbedder()


def contextualizer_of(config: Provider, key: str = "", system: str | None = None, **more) -> Contextualizer:
    return _made(CONTEXTUALIZERS, config, {"key": key, "system": system or DEFAULT_PROMPT, **more}) if config.model.strip() else NullContextualizer()
