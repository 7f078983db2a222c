"""Callables for services that speak the usual chat and embeddings protocol over HTTP."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable


def _post(url: str, body: dict, key: str | None, seconds: float, tries: int) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=seconds) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in (408, 429, 500, 502, 503, 504) or k + 1 == tries:
                raise
        except OSError:
            if k + 1 == tries:
                raise
        time.sleep(2**k)
    raise ValueError("tries must be at least 1")


def chat(url: str, model: str, *, key_variable: str = "", temperature: float = 0.0, most_tokens: int = 1000, seconds: float = 60, tries: int = 3) -> Callable[[str], str]:
    """Text to text by ``url``/chat/completions. The key is read from an environment variable where the call is made."""

    def call(prompt: str) -> str:
        body = {"model": model, "temperature": temperature, "max_tokens": most_tokens, "messages": [{"role": "user", "content": prompt}]}
        return _post(f"{url.rstrip('/')}/chat/completions", body, os.environ.get(key_variable), seconds, tries)["choices"][0]["message"]["content"]

    return call


def embedder(url: str, model: str, *, key_variable: str = "", seconds: float = 60, tries: int = 3) -> Callable[[list[str]], list[list[float]]]:
    """Texts to vectors by ``url``/embeddings."""

    def call(texts: list[str]) -> list[list[float]]:
        got = _post(f"{url.rstrip('/')}/embeddings", {"model": model, "input": texts}, os.environ.get(key_variable), seconds, tries)["data"]
        return [x["embedding"] for x in sorted(got, key=lambda x: x["index"])]

    return call
