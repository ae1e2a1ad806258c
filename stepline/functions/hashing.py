"""Keyed hashes: the only source of randomness.

A draw is a function of (seed, row key, purpose), so it does not change when rows move
between partitions or a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13  # 52 bits: exact in a double
TWO_52 = float(2**52)


def keyed(seed: int | str, *parts: Column | str) -> Column:
    """sha256 hex of ``seed:part:part...``; ordering by it is a keyed shuffle."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


def unit(hexes: Column) -> Column:
    """The leading 52 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(hexes, 1, HEX_DIGITS), 16, 10).cast("long") / F.lit(TWO_52)


def uniform(seed: int | str, *parts: Column | str) -> Column:
    return unit(keyed(seed, *parts))


def uniform_int(seed: int | str, low: Column | int, high: Column | int, *parts: Column | str) -> Column:
    """A whole number in [low, high], both ends included."""
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return (lo + F.floor(uniform(seed, *parts) * (hi - lo + 1))).cast("long")


def hex_mod(hexes: Column, modulus: int) -> Column:
    """The whole 256-bit digest modulo a small number, folded eight hex digits at a time."""
    step = pow(16, 8, modulus)
    value = F.lit(0).cast("long")
    for i in range(8):
        chunk = F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 10).cast("long")
        value = (value * step + chunk) % modulus
    return value


def fraction_split(hexes: Column, test: float, dev: float) -> Column:
    """test / dev / train by the position of a digest in [0, 1)."""
    u = unit(hexes)
    return F.when(u < test, "test").when(u < test + dev, "dev").otherwise("train")
