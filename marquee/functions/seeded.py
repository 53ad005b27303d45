"""Seeded pseudo-random numbers from plain integer arithmetic.

A value is a function of (id, slot, seed, salt) only, so a draw is the same at
any partitioning, on a task retry, and in any SQL engine (the oracle side
evaluates the same formula).  All intermediate products stay below 2^62.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus (2^31 - 1), multiplier and offsets of the generator.
PM_MODULUS = 2147483647
PM_MULTIPLIER = 48271
MIX_OFFSETS = (12345, 67890)


def seeded_int(id_col: Column, slot: Column, seed: int, salt: int = 0) -> Column:
    """Integer in [0, 2^31 - 1): a linear seed, then two rounds of squaring
    (non-linear mixing) and a Park–Miller step, all modulo 2^31 - 1."""
    m = F.lit(PM_MODULUS)
    x = F.pmod(id_col.cast("long") * 31 + slot.cast("long") * 1000003 + F.lit(seed * 7919 + salt * 104729), m)
    for off in MIX_OFFSETS:
        x = F.pmod(x * x + off, m)
        x = F.pmod(x * PM_MULTIPLIER, m)
    return x


def seeded_uniform(id_col: Column, slot: Column, seed: int, salt: int = 0) -> Column:
    """Uniform on (0, 1)."""
    return (seeded_int(id_col, slot, seed, salt).cast("double") + 0.5) / float(PM_MODULUS)


def seeded_uniform_text(id_expr: str, slot: int, seed: int, salt: int = 0) -> str:
    """:func:`seeded_uniform` of a fixed slot as Spark SQL text, which is one call where columns take dozens."""
    x = f"pmod(cast({id_expr} as bigint) * 31L + {slot * 1000003 + seed * 7919 + salt * 104729}L, {PM_MODULUS}L)"
    for off in MIX_OFFSETS:
        x = f"pmod(pmod({x} * {x} + {off}L, {PM_MODULUS}L) * {PM_MULTIPLIER}L, {PM_MODULUS}L)"
    return f"((cast({x} as double) + 0.5D) / {PM_MODULUS}.0D)"


def seeded_int_sql(id_expr: str, slot_expr: str, seed: int, salt: int = 0) -> str:
    """The same integer as SQL text (for the DuckDB oracle)."""
    m = PM_MODULUS
    x = f"((({id_expr} * 31 + {slot_expr} * 1000003 + {seed * 7919 + salt * 104729}) % {m} + {m}) % {m})"
    for off in MIX_OFFSETS:
        x = f"((({x} * {x} + {off}) % {m}) * {PM_MULTIPLIER} % {m})"
    return x


def seeded_uniform_sql(id_expr: str, slot_expr: str, seed: int, salt: int = 0) -> str:
    return f"(({seeded_int_sql(id_expr, slot_expr, seed, salt)} + 0.5) / {PM_MODULUS}.0)"
