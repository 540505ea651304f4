"""Stand-ins for the embedding, text and OCR models."""

from __future__ import annotations

import hashlib
import math


def hash_embed(texts: list[str], dim: int = 16) -> list[list[float]]:
    """A unit vector for each text: its words hashed into ``dim`` signed buckets."""
    out = []
    for text in texts:
        v = [0.0] * dim
        for w in text.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little")
            v[h % dim] += 1.0 if h & 256 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / n for x in v])
    return out


def echo(prompt: str) -> str:
    return f"{len(prompt)}:{prompt[:20]}"


def fixed_ocr(data: bytes, mime: str) -> str:
    return f"text of {len(data)} bytes, {mime}"
