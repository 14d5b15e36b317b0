"""Keccak-256 and checksummed addresses, by whole columns.

Spark has no Keccak (its SHA-3 relatives pad otherwise), so the sponge is numpy over Arrow batches: 25 lanes of 64 bits, each
an array with a place for every row of the batch. A round is some hundred operations on arrays, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .scalars import is_address

#: Bytes taken up between two permutations, for 256 bits of output.
RATE = 136
ROUNDS = 24


def round_constants() -> list[int]:
    """Bits of a shift register with feedback x^8 + x^6 + x^5 + x^4 + 1, seven for each round at places 2^j - 1."""
    out, register = [], 1
    for _ in range(ROUNDS):
        word = 0
        for j in range(7):
            word |= (register & 1) << ((1 << j) - 1)
            register <<= 1
            if register >> 8:
                register ^= 0x171
        out.append(word)
    return out


def rotations() -> list[tuple[int, int, int]]:
    """``from, to, bits`` for each lane: where it goes and how far it turns; lane (x, y) is number ``x + 5 * y``."""
    out, x, y = [(0, 0, 0)], 1, 0
    for t in range(24):
        out.append((x + 5 * y, y + 5 * ((2 * x + 3 * y) % 5), (t + 1) * (t + 2) // 2 % 64))
        x, y = y, (2 * x + 3 * y) % 5
    return out


_CONSTANTS = [np.uint64(c) for c in round_constants()]
_TURNS = rotations()


def _turned(lane: np.ndarray, bits: int) -> np.ndarray:
    return lane if not bits else (lane << np.uint64(bits)) | (lane >> np.uint64(64 - bits))


def permuted(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """The permutation of the sponge, over 25 arrays of lanes."""
    for constant in _CONSTANTS:
        columns = [lanes[x] ^ lanes[x + 5] ^ lanes[x + 10] ^ lanes[x + 15] ^ lanes[x + 20] for x in range(5)]
        mixed = [columns[(x + 4) % 5] ^ _turned(columns[(x + 1) % 5], 1) for x in range(5)]
        moved: list = [None] * 25
        for a, b, bits in _TURNS:
            moved[b] = _turned(lanes[a] ^ mixed[a % 5], bits)
        lanes = [moved[i] ^ (~moved[i // 5 * 5 + (i + 1) % 5] & moved[i // 5 * 5 + (i + 2) % 5]) for i in range(25)]
        lanes[0] = lanes[0] ^ constant
    return lanes


def keccak256(messages: list[bytes]) -> np.ndarray:
    """Digests of the messages as an array of 32 bytes a row. Messages of any lengths; each block is absorbed for all rows that have it."""
    n = len(messages)
    data = np.frombuffer(b"".join(messages) + b"\0", np.uint8)
    length = np.array([len(m) for m in messages], np.int64)
    starts, blocks = np.cumsum(length) - length, length // RATE + 1
    lanes = [np.zeros(n, np.uint64) for _ in range(25)]
    out, place = np.zeros((n, 32), np.uint8), np.arange(RATE)
    for b in range(int(blocks.max()) if n else 0):
        here = np.flatnonzero(blocks > b)
        left = (length[here] - b * RATE)[:, None]
        at = np.minimum((starts[here] + b * RATE)[:, None] + place, len(data) - 1)
        block = np.where(place < left, data[at], 0).astype(np.uint8)
        last = blocks[here] == b + 1
        block[last] ^= (place == left[last]).astype(np.uint8)
        block[last, RATE - 1] ^= 128
        words = block.view("<u8")
        taken = permuted([lanes[i][here] ^ words[:, i] if i < RATE // 8 else lanes[i][here] for i in range(25)])
        for i in range(25):
            lanes[i][here] = taken[i]
        done = here[last]
        out[done] = np.stack([lanes[i][done] for i in range(4)], axis=1).astype("<u8").view(np.uint8)
    return out


def checksummed(addresses: list[str]) -> list[str]:
    """EIP-55 forms of valid addresses: a letter is upper case where the hash of the lower-case digits has a nibble over 7."""
    if not addresses:
        return []
    digits = [a[2:].lower().encode() for a in addresses]
    text = np.frombuffer(b"".join(digits), np.uint8).reshape(-1, 40)
    digest = keccak256(digits)
    nibbles = np.stack([digest >> 4, digest & 15], axis=2).reshape(len(digits), 64)[:, :40]
    cased = np.where((text >= ord("a")) & (nibbles > 7), text - 32, text).astype(np.uint8)
    whole = np.concatenate([np.tile(np.frombuffer(b"0x", np.uint8), (len(digits), 1)), cased], axis=1)
    return [row.tobytes().decode() for row in whole]


def _checksums(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for addresses in batches:
        good = addresses.notna().to_numpy()
        out = pd.Series([None] * len(addresses), dtype=object)
        out[good] = checksummed(addresses[good].tolist())
        yield out


def to_checksum_address(address: Column) -> Column:
    """The EIP-55 form of an address in any case; null where it isn't one."""
    column = F.pandas_udf(_checksums, "string")
    return column(F.when(is_address(address), address))


def checksum_addresses(rows: DataFrame, address: str = "address") -> DataFrame:
    """``rows`` with ``checksum`` and ``form``: ``lower``, ``upper``, ``checksummed``, ``wrong`` or ``invalid``.

    Addresses without letters, which look the same in any form, are ``checksummed``; mixed cases that don't fit the checksum
    are ``wrong``. Null addresses are ``invalid``, with a null checksum. A column named like the added ones is replaced.
    """
    at, digits = F.col(f"`{address}`"), F.substring(F.col(f"`{address}`"), 3, 40)
    out = rows.withColumn("checksum", to_checksum_address(at))
    form = F.when(F.col("checksum").isNull(), "invalid").when(F.col("checksum") == at, "checksummed").when(digits == F.lower(digits), "lower").when(digits == F.upper(digits), "upper")
    return out.withColumn("form", form.otherwise("wrong"))
