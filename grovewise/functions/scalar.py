"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dna_index(state: Column) -> Column:
    """A, C, T, G to 0, 1, 2, 3, from two bits of the character."""
    return F.shiftright(F.ascii(state).bitwiseAND(6), 1)


def numeric_index(state: Column) -> Column:
    return F.ascii(state) - 48


def hash64(*cols: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def hash128(*cols: Column, seed: int = 0) -> Column:
    return F.struct(hash64(*cols, seed=seed).alias("hi"), hash64(*cols, seed=seed + 1).alias("lo"))


def edge_hash(parent: Column, child: Column) -> Column:
    return F.xxhash64(parent, child)


def in_range(x: Column, kind: str) -> Column:
    """Whether a number fits the type without loss of range."""
    return x.isNull() | F.try_cast(x, kind).isNotNull() if hasattr(F, "try_cast") else x.isNull() | x.try_cast(kind).isNotNull()


def checked_cast(x: Column, kind: str) -> Column:
    """A cast that fails on overflow, whatever the session's ANSI setting."""
    return F.when(in_range(x, kind), x.try_cast(kind)).otherwise(F.raise_error(F.concat(F.lit(f"out of range for {kind}: "), x.cast("string"))))


def ns_to_ms(x: Column) -> Column:
    return x / 1e6


def with_sd(mean: Column, sd: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(mean, digits), F.lit(" ± "), F.format_number(sd, digits))
