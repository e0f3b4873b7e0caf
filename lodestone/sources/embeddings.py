"""Embedding providers behind one protocol, and their batched use over a DataFrame."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import embedding_safe

BATCH = 20
DEFAULT_BASE, DEFAULT_MODEL = "https://api.openai.com/v1", "text-embedding-3-small"


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HashProvider:
    """Deterministic unit vectors from a text's hash; needs no network."""

    dims: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:8], "big"))
            v = rng.standard_normal(self.dims)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


@dataclass
class ZeroProvider:
    dims: int = 1536

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[0.0] * self.dims for _ in texts]


@dataclass
class HttpProvider:
    """A service with the common ``/embeddings`` call; settings come from the environment."""

    base: str = field(default_factory=lambda: os.environ.get("OPENAI_BASE_URL", DEFAULT_BASE).rstrip("/"))
    model: str = field(default_factory=lambda: os.environ.get("EMBEDDING_MODEL") or os.environ.get("OPENAI_EMBEDDING_MODEL") or DEFAULT_MODEL)
    key: str = field(default_factory=lambda: os.environ.get("OPENAI_API_KEY", ""))
    num_ctx: int = field(default_factory=lambda: int(os.environ.get("OLLAMA_NUM_CTX") or os.environ.get("EMBEDDING_NUM_CTX") or 0))
    max_chars: int = field(default_factory=lambda: int(os.environ.get("EMBEDDING_MAX_INPUT_CHARS") or 0))
    timeout: float = 30.0

    def request(self, texts: list[str]) -> dict:
        if not self.key and self.base == DEFAULT_BASE:
            raise ValueError("no API key is set")
        most = self.max_chars or (max(1, self.num_ctx * 2 // max(1, len(texts))) if self.num_ctx else 0)
        cut = [t[:most] if most > 0 else t for t in texts]
        return {"model": self.model, "input": cut[0] if len(cut) == 1 else cut} | ({"options": {"num_ctx": self.num_ctx}} if self.num_ctx else {})

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), BATCH):
            body = json.dumps(self.request(texts[k : k + BATCH])).encode()
            call = urllib.request.Request(f"{self.base}/embeddings", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
            with urllib.request.urlopen(call, timeout=self.timeout) as answer:
                out += [x["embedding"] for x in json.load(answer)["data"]]
        return out


def embed_chunks(chunks: DataFrame, provider: Provider, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """``key, embedding, status``: texts fit for embedding, in batches; a failing batch says so in its rows."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), BATCH):
                part = frame.iloc[k : k + BATCH]
                try:
                    vectors, status = provider.embed(part[text].tolist()), "ok"
                except Exception as e:  # a provider may fail in any way; the run goes on
                    vectors, status = [None] * len(part), f"failed: {type(e).__name__}"
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": vectors, "status": status})

    return chunks.select(key, text).where(embedding_safe(F.col(text))).mapInPandas(run, f"`{key}` {kind}, embedding array<float>, status string")
