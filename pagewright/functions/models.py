"""Plug points for models. Nothing here opens a socket; offline doubles are deterministic."""

from __future__ import annotations

import hashlib
import ipaddress
import socket
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import config as C


class Embedder(Protocol):
    """X01. ``embed`` gives one vector a text, or None where it failed; the prefixes stand before queries and documents."""

    model: str
    query_prefix: str
    document_prefix: str

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]: ...

    def healthcheck(self) -> bool: ...


class PairScorer(Protocol):
    """X02."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> list[float]: ...


class Prefixer(Protocol):
    """X03."""

    def prefix(self, page: str, chunk: str) -> str: ...


class Judge(Protocol):
    """Verdicts and ideas come in as tables; this is where a live one would attach."""

    def judge(self, left: str, right: str) -> dict[str, str]: ...


class HashEmbedder:
    """Deterministic offline double: signed hashed words, length 1."""

    def __init__(self, size: int = 64, model: str = "hash"):
        self.size, self.model, self.query_prefix, self.document_prefix = size, model, "", ""

    def healthcheck(self) -> bool:
        return True

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def embed_missing(chunks: DataFrame, cache: DataFrame, embedder: Embedder, scheme: str, batch: int = 64, cap: int = 8000) -> DataFrame:
    """Vectors of the texts that the cache lacks, each distinct text once: ``model, scheme, input_hash, vector``.

    ``chunks``: (input_hash, text). A batch that fails is tried text by text; texts that fail alone fall away.
    """
    live = cache.filter((F.col("model") == embedder.model) & (F.col("scheme") == scheme)).select("input_hash")
    todo = chunks.select("input_hash", F.substring("text", 1, cap).alias("text")).dropDuplicates(["input_hash"]).join(live, "input_hash", "left_anti")

    def one(text: str) -> list[float] | None:
        try:
            return embedder.embed([embedder.document_prefix + text])[0]
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                try:
                    got = embedder.embed([embedder.document_prefix + t for t in part["text"]])
                except Exception:
                    got = [one(t) for t in part["text"]]
                keep = [v is not None for v in got]
                yield pd.DataFrame({"model": embedder.model, "scheme": scheme, "input_hash": part["input_hash"][keep], "vector": [v for v in got if v is not None]})

    return todo.mapInPandas(run, "model string, scheme string, input_hash string, vector array<double>")


def task_prefixes(model: str) -> tuple[str, str]:
    """The query's and the document's prefix of a model, by the family that its name holds. An unknown family is an error: vectors
    without their prefixes look right and are not."""
    for family, prefixes in C.MODEL_PREFIXES.items():
        if family in model:
            return prefixes
    raise ValueError(f"no prefixes known for the model {model!r}; known families: {', '.join(C.MODEL_PREFIXES)}")


def separable(texts: Sequence[str], separator: str, cap: int = 8000) -> list[str]:
    """Texts that a batch joined by ``separator`` can hold: without it, cut at ``cap``, and never empty, so that vectors keep their places."""
    return [t.replace(separator, " ")[:cap] or " " for t in texts]


def split_served(models: Sequence[str], served: Callable[[str], bool]) -> tuple[list[str], list[str]]:
    """The models that a backend can serve now, and the others; a run goes on with the first."""
    found = {m: served(m) for m in models}
    return [m for m in models if found[m]], [m for m in models if not found[m]]


#: The tiers that make prefixes, best first, and where each turns when it fails. No tier falls back on a dearer one.
PREFIX_FALLBACK = {"api": ("cli", "synthetic"), "cli": ("synthetic",), "synthetic": ()}


def prefix_tier(available: Sequence[str], egress: bool = False, synthetic: bool = False) -> str:
    """The best available tier; without leave to send texts out it is always the synthetic one."""
    if synthetic or not egress:
        return "synthetic"
    return next((t for t in PREFIX_FALLBACK if t in available), "synthetic")


def make_prefix(tier: str, makers: dict[str, Callable[[str, str], str | None]], page: str, chunk: str) -> tuple[str, str]:
    """A chunk's prefix and the tier that made it; a tier without a maker or whose maker gives nothing or fails passes it on."""
    for t in (tier, *PREFIX_FALLBACK[tier]):
        try:
            made = makers[t](page, chunk) if t in makers else None
        except Exception:
            made = None
        if made:
            return made, t
    return "", "synthetic"


class OverlapScorer:
    """Deterministic offline double of a pair scorer: the share of the query's words that the text has."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
        words = [(set(q.lower().split()), set(t.lower().split())) for q, t in pairs]
        return [len(q & t) / len(q) if q else 0.0 for q, t in words]


def usable(embedder: Embedder, listed: Sequence[str], answered: str | None = None) -> str:
    """X11: why a scan must not start with this embedder, or an empty text: it is out of reach, its model is not listed, another model
    answers in its place (``answered``), or a trial text gets no vector."""
    if not embedder.healthcheck():
        return "out of reach"
    if embedder.model not in listed:
        return "model not listed"
    if answered is not None and answered != embedder.model:
        return f"answered by {answered}"
    try:
        trial = embedder.embed([embedder.document_prefix + "trial"])
    except Exception:
        trial = []
    return "" if len(trial) == 1 and trial[0] is not None and any(trial[0]) else "no vector for a trial text"


def pick_backend(*backends: Embedder) -> Embedder | None:
    """The first that is healthy."""
    return next((b for b in backends if b.healthcheck()), None)


def endpoint_allowed(url: str, public: bool = False, resolve: Callable[..., list] = socket.getaddrinfo) -> bool:
    """F16: only hosts of which every address is non-global; what does not resolve is refused."""
    host = urlsplit(url).hostname
    if public or not host:
        return public
    try:
        found = {r[4][0].split("%")[0] for r in resolve(host, None)}
    except OSError:
        return False
    return bool(found) and not any(ipaddress.ip_address(a).is_global for a in found)
