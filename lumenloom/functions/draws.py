"""Counter-based random numbers: Philox4x32-10 as columns, in numpy and as SQL, with the same integers in all three.

A draw depends on a seed, tags, the row's key and a counter alone, so it is the same however rows
are partitioned, and any draw of a row can be made without the ones before it.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers and key increments of the generator.
M0, M1 = 0xD2511F53, 0xCD9E8D57
W0, W1 = 0x9E3779B9, 0xBB67AE85
ROUNDS = 10
_MASK = 0xFFFFFFFF


def scope(seed: int, *tags) -> tuple[int, int]:
    """The generator's two key words for a seed and tags: the first 64 bits of SHA-256 of the joined parts."""
    digest = hashlib.sha256("|".join(str(x) for x in (seed, *tags)).encode()).digest()
    return int.from_bytes(digest[:4], "big"), int.from_bytes(digest[4:8], "big")


def row_words(*key: Column) -> tuple[Column, Column]:
    """Two 32-bit words of a row's key: of the MD5 of its parts as text, joined by bars; nulls as a lone hyphen."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("-")) for k in key]))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return word(1), word(9)


def _product(m: int, x: Column) -> tuple[Column, Column]:
    """(high, low) 32 bits of a product, from halves, as the whole does not fit a signed long."""
    low, high = x.bitwiseAND(0xFFFF) * m, F.shiftright(x, 16) * m
    middle = high + F.shiftright(low, 16)
    return F.shiftright(middle, 16), F.shiftleft(middle.bitwiseAND(0xFFFF), 16) + low.bitwiseAND(0xFFFF)


def philox(counter: list[Column], key: tuple[int, int]) -> Column:
    """array of four 32-bit words (long) for four counter words."""

    def one(state: Column, n: Column) -> Column:
        at = lambda i: F.get(state, F.lit(i))
        high0, low0 = _product(M0, at(0))
        high1, low1 = _product(M1, at(2))
        k0, k1 = ((F.lit(k).cast("long") + n * w).bitwiseAND(_MASK) for k, w in zip(key, (W0, W1), strict=True))
        return F.array(high1.bitwiseXOR(at(1)).bitwiseXOR(k0), low1, high0.bitwiseXOR(at(3)).bitwiseXOR(k1), low0)

    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
    return F.aggregate(rounds, F.array(*[c.cast("long") for c in counter]), one)


def words(key: tuple[Column, Column], n: int, seed: int, *tags) -> Column:
    """array of ``n`` 32-bit words of a row, whose key is ``row_words``."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit((n + 3) // 4 - 1)), lambda b: philox([key[0], key[1], b, F.lit(0)], scope(seed, *tags)))
    return F.slice(F.flatten(blocks), 1, n)


def uniforms(key: tuple[Column, Column], n: int, seed: int, *tags) -> Column:
    """array of ``n`` doubles in [0, 1), 53 bits of two words each."""
    w = words(key, 2 * n, seed, *tags)
    pair = lambda i: (F.shiftright(F.get(w, 2 * i), 5) * (1 << 26) + F.shiftright(F.get(w, 2 * i + 1), 6)) / F.lit(float(1 << 53))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pair)


def philox_numpy(counter: list[np.ndarray], key: tuple[int, int]) -> np.ndarray:
    """The same four words, along a new first axis; counter words are uint64 arrays that broadcast."""
    c0, c1, c2, c3 = (np.asarray(c, dtype=np.uint64) for c in counter)
    k0, k1 = key
    mask, shift = np.uint64(_MASK), np.uint64(32)
    for _ in range(ROUNDS):
        p0, p1 = c0 * np.uint64(M0), c2 * np.uint64(M1)
        c0, c1, c2, c3 = (p1 >> shift) ^ c1 ^ np.uint64(k0), p1 & mask, (p0 >> shift) ^ c3 ^ np.uint64(k1), p0 & mask
        k0, k1 = (k0 + W0) & _MASK, (k1 + W1) & _MASK
    return np.stack(np.broadcast_arrays(c0, c1, c2, c3))


def philox_sql(source: str, counter: tuple[str, str, str, str], key: tuple[int, int], carry: str) -> str:
    """DuckDB SQL that selects ``carry`` and the words c0 .. c3 for rows of ``source``."""
    state = ", ".join(f"({c})::UBIGINT AS c{i}" for i, c in enumerate(counter))
    sql = f"SELECT {carry}, {state} FROM {source}"
    for n in range(ROUNDS):
        k0, k1 = (key[0] + n * W0) & _MASK, (key[1] + n * W1) & _MASK
        sql = (
            f"SELECT {carry}, xor(xor((c2 * {M1}::UBIGINT) >> 32, c1), {k0}::UBIGINT) AS c0, (c2 * {M1}::UBIGINT) & {_MASK}::UBIGINT AS c1, "
            f"xor(xor((c0 * {M0}::UBIGINT) >> 32, c3), {k1}::UBIGINT) AS c2, (c0 * {M0}::UBIGINT) & {_MASK}::UBIGINT AS c3 FROM ({sql})"
        )
    return sql


def poisson_steps() -> list[int]:
    """Where a 32-bit word's Poisson(1) count goes up by one: cumulative probabilities in 32 bits, up to 7."""
    out, total, p = [], 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        out.append(round(total * (1 << 32)))
        p /= k
    return out
