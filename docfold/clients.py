"""Text models: callables from a prompt to chunks of text. They travel to tasks, so they hold no connection."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

from docfold.functions.text import ERROR_CODE, ERROR_LENGTH, PARAGRAPH, ROOT_PATTERNS, TITLE, WHITE

TIMEOUT = 300
BASE_URL = "https://api.openai.com/v1"


class Client(Protocol):
    def __call__(self, prompt: str) -> Iterable[str]: ...


@dataclass(frozen=True)
class Echo:
    """Says that nothing is new, deterministically."""

    fallback: str = "root"

    def __call__(self, prompt: str) -> Iterator[str]:
        for pattern in ROOT_PATTERNS:
            if m := re.search(pattern, prompt):
                yield f"{m[1]}: []"
                return
        yield f"{self.fallback}: []"


@dataclass(frozen=True)
class Scripted:
    """Answers by the first key that the prompt has; an answer that is an exception is raised."""

    answers: dict[str, Any] = field(default_factory=dict)
    default: str = ""

    def __call__(self, prompt: str) -> Iterator[str]:
        for key, answer in self.answers.items():
            if key in prompt:
                if isinstance(answer, Exception):
                    raise answer
                yield from [answer] if isinstance(answer, str) else answer
                return
        yield self.default


def delta_of(chunk: Any) -> str:
    """Text of one chunk of a chat completion; empty for anything else."""
    try:
        content = chunk["choices"][0]["delta"]["content"]
    except (KeyError, IndexError, TypeError):
        return ""
    if isinstance(content, list):
        parts = [x.get("text", "") if isinstance(x, dict) else x for x in content]
        return "".join(x for x in parts if isinstance(x, str))
    return content if isinstance(content, str) else ""


@dataclass(frozen=True)
class ChatStream:
    """A service that streams chat completions as server-sent events."""

    url: str
    model: str
    api_key: str = ""
    timeout: float = TIMEOUT

    def __call__(self, prompt: str) -> Iterator[str]:
        if not self.api_key:
            raise RuntimeError("the service's key (model.api_key) is missing")
        body = {"model": self.model, "stream": True, "messages": [{"role": "user", "content": prompt}]}
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Accept": "text/event-stream", "Authorization": f"Bearer {self.api_key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                for raw in response:
                    line = raw.decode("utf-8", "replace").strip()
                    if not line.startswith("data:"):
                        continue
                    data = line[5:].strip()
                    if data == "[DONE]":
                        return
                    try:
                        text = delta_of(json.loads(data))
                    except ValueError as e:
                        raise RuntimeError(f"chunk is no JSON: {data[:80]}") from e
                    if text:
                        yield text
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"HTTP {e.code}: {error_text(e.read().decode('utf-8', 'replace')) or e.reason}") from e


def error_text(body: str) -> str:
    """The best of an error's body: of a page its title and first paragraph; white space collapsed, 240 at most."""
    low = body.lower()
    if "<html" in low or "<!doctype html" in low:
        part = lambda pattern: compact(re.sub(r"<[^>]+>", " ", m[1])) if (m := re.search(pattern, body)) else ""
        code = re.search(ERROR_CODE, body)
        body = " | ".join(p for p in (part(TITLE), f"Cloudflare {code[1]}" if code else "", part(PARAGRAPH)) if p) or body
    return compact(body)


def compact(text: str, most: int = ERROR_LENGTH) -> str:
    """White space collapsed, trimmed, and cut with dots."""
    text = re.sub(WHITE, " ", text).strip(" ")
    return text if len(text) <= most else text[: most - 3] + "..."


def client_of(model: dict[str, Any]) -> Client:
    """The service if there is a key for it, whatever else is given; else the echo. An explicit ``provider: echo`` stays one."""
    if not model.get("api_key") or model.get("provider") == "echo":
        return Echo()
    return ChatStream(str(model.get("base_url") or BASE_URL), str(model.get("name") or ""), str(model["api_key"]))
