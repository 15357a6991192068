"""Seeded pseudo-random numbers and clamping on columns; the constants are parts of the generators' definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def times_32(a: Column, b: Column) -> Column:
    """Product modulo 2^32 of two numbers in [0, 2^32), by halves, since ANSI arithmetic does not wrap."""
    high = F.shiftrightunsigned(a, 16)
    low = a.bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16) + low * b).bitwiseAND(F.lit(_LOW))


def mulberry32(seed: Column) -> Column:
    """First number in [0, 1) of the mulberry32 generator."""
    a = (seed.cast("long") + F.lit(0x6D2B79F5)).bitwiseAND(F.lit(_LOW))
    t = times_32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    mixed = times_32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))
    t = t.bitwiseXOR((t + mixed).bitwiseAND(F.lit(_LOW)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def lcg(seed: Column, steps: int) -> Column:
    """State after `steps` steps of r -> (9301 r + 49297) mod 233280."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), seed.cast("long"), lambda r, _: (r * 9301 + 49297) % 233280)


def sine_noise(i: Column) -> Column:
    """Fraction of a large sine; the sign stays, as for a remainder."""
    return (F.sin(i * F.lit(12.9898)) * F.lit(43758.5453)) % F.lit(1.0)


def pseudo_gaussian(a: Column, b: Column, c: Column) -> Column:
    """Three numbers in [0, 1) give one in [-1, 1)."""
    return (a + b + c - 1.5) / 1.5
