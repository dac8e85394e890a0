"""Removed byte runs of documents: from spans to counts, digests and texts."""

from __future__ import annotations

import hashlib


def joined(spans) -> list[tuple[int, int]]:
    """Maximal runs of (start, end) spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without its removed runs."""
    at, parts = 0, []
    for start, end in runs:
        parts.append(text[at:start])
        at = end
    return b"".join([*parts, text[at:]])


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
