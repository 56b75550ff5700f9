"""Numbers in [0, 2**32) and [0, 1) that depend on a row's id alone.

Reruns, lost executors and other partitionings give the same rows the same number, which ``rand()``
does not. The arithmetic is plain BIGINT, so the same rule can be written in any SQL dialect.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32

_LOW_BITS = (1 << 31) - 1
_HIGH = 40503
_LAST = 2053222611


def salt_constants(salt: int) -> tuple[int, int]:
    """An odd multiplier in [2**30, 2**31) and an offset in [0, 2**32) for each salt."""
    digest = hashlib.md5(str(salt).encode()).digest()
    factor = (1 << 30) | (int.from_bytes(digest[:4], "big") >> 2) | 1
    return factor, int.from_bytes(digest[4:8], "big")


def mix(key: Column, salt: int = 0) -> Column:
    """A whole number in [0, 2**32) from a BIGINT key: multiply, fold the high bits, multiply.

    The key appears in few places, so that dozens of such columns still fit one generated method.
    """
    factor, offset = salt_constants(salt)
    key = key.cast("bigint")
    low = key.bitwiseAND(F.lit(_LOW_BITS))
    high = F.shiftrightunsigned(key, 31)
    x = (low * F.lit(factor) + high * F.lit(_HIGH) + F.lit(offset)) % F.lit(SPAN)
    return (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(_LAST)) % F.lit(SPAN)


def uniform(key: Column, salt: int = 0) -> Column:
    """A double in [0, 1)."""
    return mix(key, salt).cast("double") / F.lit(float(SPAN))


def pick(key: Column, n: int, salt: int = 0) -> Column:
    """A whole number in [0, n) for n up to 2**63: two mixes give 62 bits before the modulus."""
    wide = F.shiftright(mix(key, salt), 1) * F.lit(1 << 31) + F.shiftright(mix(key, salt + 7919), 1)
    return wide % F.lit(n)


def as_key(column: Column, is_text: bool) -> Column:
    """A BIGINT for a key column of any type."""
    return F.xxhash64(column) if is_text else column.cast("bigint")


def exponential(key: Column, scale: float, salt: int) -> Column:
    return -F.log1p(-uniform(key, salt)) * F.lit(scale)


def normal(key: Column, mean: float, std: float, salt: int) -> Column:
    """Box-Muller from two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log1p(-uniform(key, salt)))
    angle = F.lit(2.0) * F.pi() * uniform(key, salt + 1)
    return F.lit(mean) + F.lit(std) * radius * F.cos(angle)


def choice(key: Column, values: list, salt: int) -> Column:
    """One of the values, each with the same chance."""
    place = F.floor(uniform(key, salt) * F.lit(float(len(values)))).cast("int")
    return F.get(F.array(*[F.lit(v) for v in values]), place)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
