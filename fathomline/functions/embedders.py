"""What an embedder is, and embedders around a local model or a remote service.

An embedder has `model`, `dim` and `embed`; one with `embed_query` embeds queries another way.  `vectors.embedded` runs any
of them over a column, a batch of 64 texts at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Protocol

from .vectors import HashEmbedder

BATCH = 64


class Embedder(Protocol):
    model: str
    dim: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class LocalEmbedder:
    """A model that `load` makes once in each worker: a function of a list of texts.  Queries and passages may carry
    prefixes, as some models want."""

    def __init__(self, model: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], passage: str = "", query: str = ""):
        self.model, self.load, self.passage, self.query = model, load, passage, query
        self._run = None

    def __getstate__(self):
        return self.__dict__ | {"_run": None}  # models don't travel

    def _vectors(self, texts: list[str]) -> list[list[float]]:
        if self._run is None:
            self._run = self.load()
        return [list(map(float, v)) for at in range(0, len(texts), BATCH) for v in self._run(texts[at : at + BATCH])]

    @property
    def dim(self) -> int:
        return len(self._vectors(["dimension"])[0])

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self._vectors([self.passage + t for t in texts])

    def embed_query(self, text: str) -> list[float]:
        return self._vectors([self.query + text])[0]


class RemoteEmbedder:
    """A service that `send` asks for the vectors of at most 64 texts: five tries, with waits of 1, 2, 4 ... 30 seconds."""

    def __init__(self, model: str, send: Callable[[str, list[str]], list[list[float]]], dim: int = 0, tries: int = 5, wait: Callable[[float], None] = time.sleep):
        self.model, self.send, self.tries, self.wait, self._dim = model, send, tries, wait, dim

    def _ask(self, texts: list[str]) -> list[list[float]]:
        for n in range(self.tries):
            try:
                return self.send(self.model, texts)
            except OSError:
                if n + 1 == self.tries:
                    raise
                self.wait(min(2**n, 30))
        raise AssertionError("unreachable")

    @property
    def dim(self) -> int:
        if not self._dim:
            self._dim = len(self._ask(["dimension"])[0])
        return self._dim

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        texts = list(texts)
        return [v for at in range(0, len(texts), BATCH) for v in self._ask(texts[at : at + BATCH])]


def get_embedder(kind: str = "hash", dim: int = 256, **options) -> Embedder:
    """`hash` needs nothing; `local` takes model and load, `remote` takes model and send."""
    made = {"hash": lambda: HashEmbedder(dim), "local": lambda: LocalEmbedder(**options), "remote": lambda: RemoteEmbedder(dim=dim if options.pop("fixed_dim", False) else 0, **options)}
    if kind not in made:
        raise ValueError(f"no embedder {kind!r}; there are {', '.join(made)}")
    return made[kind]()


def check_dim(known: int | None, embedder: Embedder) -> int:
    """The width of a library's vectors; vectors of two widths can't share a table."""
    if known is not None and known != embedder.dim:
        raise ValueError(f"the library's vectors have {known} dimensions and {embedder.model} makes {embedder.dim}; index anew with reset")
    return embedder.dim
