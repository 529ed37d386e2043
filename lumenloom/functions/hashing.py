"""Portable hashes: the same numbers in Spark, DuckDB and Python, so samples can be checked."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus of the 31-bit hash family; products stay under 63 bits.
PRIME = 2147483647


def _joined(parts: tuple) -> Column:
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hash32(value: Column) -> Column:
    """The first 32 bits of MD5 as a number."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def order_key(seed: int, *parts) -> Column:
    """A text whose order is the seeded order of a sample; rows keep it whatever their partition."""
    return F.md5(_joined((seed, *parts)))


def seed_column(base: int, *tags) -> Column:
    return F.conv(F.substring(F.sha2(_joined((base, *tags)), 256), 1, 8), 16, 10).cast("long")


def derive_seed(base: int, *tags) -> int:
    """The child seed of ``base`` for ``tags``: the first 32 bits of SHA-256 of the joined parts."""
    text = "|".join(str(x) for x in (base, *tags))
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")


def token_id(piece: Column) -> Column:
    """A stable 31-bit id of a token's text."""
    return hash32(piece).bitwiseAND(PRIME)


def permutations(count: int) -> list[tuple[int, int]]:
    """(a, b) of each MinHash permutation, from MD5 of its number."""
    def draw(name: str) -> int:
        return int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % PRIME

    return [(1 + draw(f"a|{i}") % (PRIME - 1), draw(f"b|{i}")) for i in range(count)]
