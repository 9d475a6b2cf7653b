"""Numbers that look random and are the same in every engine: they depend on keys and a seed only.

The first 13 hexadecimal digits of the md5 of the seed and the keys, joined by `|`, are 52 bits; SQL has md5 too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(columns, seed: int) -> Column:
    key = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def hash_order(*columns: Column | str, seed: int = 0) -> Column:
    """An integer under 2**52 to order by; ties are possible, so order by the keys as well."""
    return _bits(columns, seed)


def hash_uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1), so that retried tasks agree."""
    return (_bits(columns, seed) + F.lit(0.5)) / float(1 << 52)


def bits_sql(*columns: str, seed: int = 0) -> str:
    """`hash_order` as SQL."""
    key = " || '|' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in columns]])
    return f"CAST('0x' || md5({key})[1:13] AS BIGINT)"


def uniform_sql(*columns: str, seed: int = 0) -> str:
    """`hash_uniform` as SQL."""
    return f"(({bits_sql(*columns, seed=seed)} + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE)"
