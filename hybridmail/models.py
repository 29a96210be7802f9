"""Embedders and generators: the seams to models, with deterministic ones that need no network."""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from hybridmail.functions.analyzer import analyze
from hybridmail.errors import ModelUnavailable
from hybridmail.operators.answers import NOT_FOUND, Options


class Embedder(Protocol):
    name: str

    def embed(self, text: str) -> list[float]: ...


class Generator(Protocol):
    name: str

    def tokens(self, system: str, prompt: str, options: Options = Options()) -> Iterator[str]: ...


class HashingEmbedder:
    """Signed feature hashing of stems, of unit length; the zero vector for a text without words."""

    def __init__(self, dim: int = 128):
        self.dim, self.name = dim, f"hashing-{dim}"

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        for word in analyze(text or ""):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else v


_SOURCE = re.compile(r"\[(\d+)\] From: .*?\n    Subject: (.*?)\n.*?    Excerpt: (.*?)(?=\n\n?\[\d+\] From: |\Z)", re.S)


class ExtractiveGenerator:
    """Answers with the sentences of the sources that share most stems with the question, each with its number."""

    name = "extractive"

    def __init__(self, sentences: int = 2):
        self.sentences = sentences

    def tokens(self, system: str, prompt: str, options: Options = Options()) -> Iterator[str]:
        question, _, sources = prompt.partition("\n")
        asked = set(analyze(question))
        found = []
        for n, subject, excerpt in _SOURCE.findall(sources):
            for i, sentence in enumerate([subject, *re.split(r"(?<=[.!?])\s+", excerpt.strip())]):
                shared = len(asked & set(analyze(sentence)))
                if shared:
                    found.append((-shared, int(n), i, sentence.strip()))
        if not found:
            yield NOT_FOUND
        for k, (_, n, _, sentence) in enumerate(sorted(found)[: self.sentences]):
            yield (" " if k else "") + f"{sentence} [{n}]"


class HttpTransport:
    """Calls a model server's HTTP interface: <base>/api/<path>, a JSON body (none for tags), an answer of a JSON object a line. A refused call and an answer that isn't one are OSErrors."""

    def __init__(self, base: str = "http://127.0.0.1:11434", timeout_s: float = 120.0):
        self.base, self.timeout_s = base.rstrip("/"), timeout_s

    def __call__(self, path: str, body: dict) -> Iterator[dict]:
        asked = urllib.request.Request(f"{self.base}/api/{path}", None if path == "tags" else json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout_s) as answer:
                for line in answer:
                    if line.strip():
                        yield json.loads(line)
        except urllib.error.HTTPError as e:
            raise OSError(f"{e.code}: {e.read(300).decode(errors='replace')}") from e
        except ValueError as e:
            raise OSError(f"not an answer: {e}") from e


class ModelServer:
    """A client of a model server over a transport: call(path, body) gives the lines of the answer, parsed, and raises OSError when nobody answers."""

    def __init__(self, call: Callable[[str, dict], Iterable[dict]], *, chat_model: str, embedding_model: str):
        self._call, self.chat_model, self.name = call, chat_model, embedding_model

    def _ask(self, path: str, body: dict) -> Iterator[dict]:
        try:
            yield from self._call(path, body)
        except OSError as e:
            raise ModelUnavailable(f"no model server: {e}") from e

    def installed(self) -> list[str]:
        return [m["name"] for line in self._ask("tags", {}) for m in line.get("models", ())]

    def embed(self, text: str) -> list[float]:
        for line in self._ask("embed", {"model": self.name, "input": text}):
            if line.get("embeddings"):
                return list(map(float, line["embeddings"][0]))
        raise ModelUnavailable(f"{self.name} gave no vector")

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        for line in self._ask("embed", {"model": self.name, "input": texts}):
            if len(line.get("embeddings") or ()) == len(texts):
                return [list(map(float, v)) for v in line["embeddings"]]
        raise ModelUnavailable(f"{self.name} gave no vectors")

    def tokens(self, system: str, prompt: str, options: Options = Options()) -> Iterator[str]:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        for line in self._ask("chat", {"model": self.chat_model, "messages": messages, "stream": options.stream, "keep_alive": options.keep_alive, "options": {"temperature": options.temperature}}):
            if part := line.get("message", {}).get("content"):
                yield part
            if line.get("done"):
                return

    def unload(self, model: str) -> None:
        list(self._ask("chat", {"model": model, "messages": [], "keep_alive": 0}))

    def pull(self, model: str, on_progress: Callable[[int, int], None] | None = None, cancelled: Callable[[], bool] = lambda: False) -> bool:
        """Has the server fetch a model; False if cancelled on the way."""
        for line in self._ask("pull", {"model": model, "stream": True}):
            if line.get("error"):
                raise ModelUnavailable(line["error"])
            if on_progress and line.get("total"):
                on_progress(line.get("completed", 0), line["total"])
            if cancelled():
                return False
        return True

    def health(self) -> dict:
        """Whether the server answers, and whether the embedder and the chat model are there."""
        try:
            tags = self.installed()
        except ModelUnavailable:
            return {"reachable": False, "embedder": False, "chat_model": False}
        there = lambda model: any(t == model or t.split(":")[0] == model.split(":")[0] for t in tags)
        return {"reachable": True, "embedder": there(self.name), "chat_model": any(t == self.chat_model or t.startswith(f"{self.chat_model}-") for t in tags)}


def folded(parts: Iterable[str], on_token: Callable[[str], None] | None = None) -> str:
    """The whole answer of a stream of parts; each is passed on as it comes."""
    out = []
    for part in parts:
        out.append(part)
        if on_token:
            on_token(part)
    return "".join(out)
