"""Draws as pure column expressions: a value depends on its key only, never on partitioning."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def get_seed(seed: int | None = None) -> int:
    """The seed itself, or a fresh one in [0, 2**31 - 1) from the system's entropy."""
    return int.from_bytes(os.urandom(8), "big") % 2147483647 if seed is None else seed


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the MD5 of the key's parts, joined by `|`."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def draw(dist: Column, amount: Column, u: Column, v: Column) -> Column:
    """A draw from a distribution by inversion; u and v are uniform. Types 0, 3, 4 and 5; null for any other.

    No distribution, or type 0, gives the amount. Normal draws come from u and v by Box and Muller.
    """
    low, high, mode = dist["minimum"], dist["maximum"], dist["loc"]
    kind = dist["uncertainty_type"]
    normal = mode + dist["scale"] * F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * F.pi() * v)
    rising = low + F.sqrt(u * (high - low) * (mode - low))
    falling = high - F.sqrt((1.0 - u) * (high - low) * (high - mode))
    triangular = F.when(u * (high - low) < mode - low, rising).otherwise(falling)
    return F.when(dist.isNull() | (kind == 0), amount).when(kind == 3, normal).when(kind == 4, low + u * (high - low)).when(kind == 5, triangular)


#: Uncertainty types that `draw` knows.
KNOWN = (0, 3, 4, 5)


def column_choice(size: Column, iteration: Column, sequential: bool, seed: int, package: str) -> Column:
    """The 1-based scenario of an iteration: the next one, wrapping around, or a seeded random one for the whole package."""
    if sequential:
        return (F.pmod(iteration, size.cast("long")) + 1).cast("int")
    return (F.floor(uniform(F.lit(seed), F.lit(package), iteration) * size) + 1).cast("int")
