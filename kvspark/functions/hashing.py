"""Hash slots, Bloom positions, checksums and key separators (OP-47, OP-58, OP-60, OP-62, OP-64)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import long_to_key
from .codec import WORD

#: Slots of the hash table, and lock segments over them.
SLOTS = 1 << 26
SEGMENTS = 256


def hash_slot(key_long: Column, slots: int = SLOTS) -> Column:
    """The high half folded into the low one, and that into its lower half (OP-58). slots: a power of two."""
    folded = F.shiftrightunsigned(key_long, 32).bitwiseXOR(key_long).bitwiseAND(F.lit(WORD))
    return folded.bitwiseXOR(F.shiftright(folded, 16)).bitwiseAND(F.lit(slots - 1))


def lock_segment(slot: Column, slots: int = SLOTS, segments: int = SEGMENTS) -> Column:
    """Equal runs of slots, the last segment taking the rest (OP-60)."""
    return F.least(F.floor(slot / (slots // segments)), F.lit(segments - 1)).cast("int")


def bloom_position(key_long: Column, i: Column, bits: Column | int) -> Column:
    """The i-th bit of a key: the first 4 bytes of md5(key, i as 4 little-endian bytes), modulo ``bits`` (OP-47). i < 256."""
    salted = F.concat(long_to_key(key_long), F.unhex(F.concat(F.lpad(F.hex(i), 2, "0"), F.lit("000000"))))
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.conv(F.substring(F.md5(salted), 1, 8), 16, 10).cast("long") % bits


def _table() -> np.ndarray:
    """Checksums of single bytes, from the reflected polynomial of CRC-32C."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


def crc32c_of(values: list[bytes | None]) -> np.ndarray:
    """CRC-32C of many byte strings at once, a byte position at a time; null counts as empty."""
    table = _table()
    sizes = np.array([len(v or b"") for v in values], np.int64)
    flat = np.frombuffer(b"".join(v or b"" for v in values), np.uint8)
    starts = np.cumsum(sizes) - sizes
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    rows = np.argsort(-sizes, kind="stable")
    for i in range(int(sizes.max(initial=0))):
        rows = rows[: np.searchsorted(-sizes[rows], -i, "left")]
        crc[rows] = table[(crc[rows] ^ flat[starts[rows] + i]) & 0xFF] ^ (crc[rows] >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def _mask(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits plus a constant, so that checksums of data that hold checksums differ."""
    return ((crc >> 15) | (crc << 17)) + np.uint32(0xA282EAD8)


@F.pandas_udf(T.LongType())
def crc32c(values: pd.Series) -> pd.Series:
    """CRC-32C of bytes, unsigned (OP-64)."""
    return pd.Series(crc32c_of(values.tolist()).astype(np.int64))


@F.pandas_udf(T.LongType())
def crc32c_masked(values: pd.Series) -> pd.Series:
    """CRC-32C of bytes in its stored form (OP-64)."""
    return pd.Series(_mask(crc32c_of(values.tolist())).astype(np.int64))


def separator_of(start: bytes, limit: bytes) -> bytes:
    """A shortest byte string above ``start`` and below ``limit``; ``start`` itself where raising the first differing
    byte by one would reach ``limit``, or where one is the other's beginning."""
    at = next((i for i, (a, b) in enumerate(zip(start, limit)) if a != b), None)
    if at is None or start[at] + 1 >= limit[at]:
        return start
    return start[:at] + bytes([start[at] + 1])


def successor_of(key: bytes) -> bytes:
    """The key cut behind its first byte that is not 0xFF, which is raised by one; all 0xFF stays."""
    at = next((i for i, b in enumerate(key) if b != 0xFF), None)
    return key if at is None else key[:at] + bytes([key[at] + 1])


def _number(b: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(b, at + 1, F.lit(1))), 16, 10).cast("long")


def _raised(b: Column, at: Column) -> Column:
    """The bytes up to ``at``, with that one raised by one."""
    return F.concat(F.substring(b, F.lit(1), at), F.unhex(F.lpad(F.hex(_number(b, at) + 1), 2, "0")))


def shortest_separator(start: Column, limit: Column) -> Column:
    """``separator_of`` for columns; null where either is (OP-62)."""
    # The longest run of whole bytes that both begin with.
    common = F.regexp_extract(F.concat(F.hex(start), F.lit("|"), F.hex(limit)), r"^((?:..)*)[^|]*\|\1", 1)
    at = (F.length(common) / 2).cast("int")
    inside = at < F.least(F.octet_length(start), F.octet_length(limit))
    return F.when(start.isNull() | limit.isNull(), F.lit(None).cast("binary")).when(inside & (_number(start, at) + 1 < _number(limit, at)), _raised(start, at)).otherwise(start)


def short_successor(key: Column) -> Column:
    """``successor_of`` for a column; null stays (OP-62)."""
    at = (F.length(F.regexp_extract(F.hex(key), "^((?:FF)*)", 1)) / 2).cast("int")
    return F.when(at < F.octet_length(key), _raised(key, at)).otherwise(key)
