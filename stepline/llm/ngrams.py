"""Hashed character n-grams of a text, piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 18  # characters handled at once; pieces overlap so that no n-gram is lost
STEP, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Buckets (0 to 2**bits - 1) of all n-grams of the lower-cased text between two spaces; none for null or empty."""
    if not text:
        return
    padded = f" {text.lower()} "
    low, high = min(orders), max(orders)
    for at in range(0, len(padded), PIECE):
        piece = padded[at : at + PIECE + high - 1]
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h, out = c + np.uint64(1), []
        for n in range(1, high + 1):
            if n > 1:
                if len(c) < n:
                    break
                h = h[:-1] * STEP + c[n - 1 :]
            if n >= low and n in orders:
                mine = h[:PIECE]
                out.append((((mine ^ (mine >> np.uint64(29))) * SPREAD) >> np.uint64(64 - bits)).astype(np.int64))
        if out:
            yield np.concatenate(out)
