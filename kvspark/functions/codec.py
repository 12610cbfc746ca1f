"""Byte codecs as column expressions (OP-51 to OP-57, OP-61, OP-63, OP-65 to OP-71)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 0xFFFFFFFF


def hex_lower(b: Column) -> Column:
    """Lowercase hex digits of bytes (OP-52)."""
    return F.lower(F.hex(b))


def _reversed_hex(digits: Column, n_bytes: int) -> Column:
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n_bytes))])


def int_to_be(n: Column) -> Column:
    """The low 32 bits as 4 big-endian bytes (OP-53)."""
    return F.unhex(F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(WORD))), 8, "0"))


def int_to_le(n: Column) -> Column:
    """The low 32 bits as 4 little-endian bytes (OP-53)."""
    return F.unhex(_reversed_hex(F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(WORD))), 8, "0"), 4))


def ints_to_be(numbers: Column) -> Column:
    """An array of ints as big-endian bytes one after the other (OP-53)."""
    return F.unhex(F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(WORD))), 8, "0")), ""))


def be_to_int(b: Column) -> Column:
    """4 big-endian bytes as a signed int."""
    return signed32(F.conv(F.hex(b), 16, 10).cast("long"))


def long_to_le(n: Column) -> Column:
    """A signed long as 8 little-endian bytes (OP-55)."""
    return F.unhex(_reversed_hex(F.lpad(F.hex(n), 16, "0"), 8))


def le_to_long(b: Column) -> Column:
    """8 little-endian bytes as a signed long (OP-55)."""
    return F.conv(_reversed_hex(F.hex(b), 8), 16, -10).cast("long")


def signed32(n: Column) -> Column:
    """The low 32 bits as a signed number, without the overflow error of a cast."""
    low = n.bitwiseAND(F.lit(WORD))
    return F.when(low > 0x7FFFFFFF, low - (1 << 32)).otherwise(low).cast("int")


def pack_ints(high: Column, low: Column) -> Column:
    """Two ints as one long (OP-56)."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(WORD)))


#: Fixed value: the nonzero nibble that marks an address as set.
ADDRESS_MARK = 0xF << 44
_OFFSET = (1 << 44) - 1


def pack_address(file: Column, offset: Column) -> Column:
    """File number above bit 48, the mark, and the byte offset (OP-57)."""
    return F.shiftleft(file.cast("long"), 48).bitwiseOR(F.lit(ADDRESS_MARK)).bitwiseOR(offset.cast("long"))


def address_file(address: Column) -> Column:
    return F.shiftrightunsigned(address, 48)


def address_offset(address: Column) -> Column:
    return address.bitwiseAND(F.lit(_OFFSET))


def compare_bytes(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes; a prefix comes first (OP-51)."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def bit_string(key_long: Column) -> Column:
    """The 64 bits of a key, the highest first (OP-63)."""
    return F.lpad(F.bin(key_long), 64, "0")


def set_bits(bits: Column) -> Column:
    """Positions of the ones in a bit string, from 0 (OP-63)."""
    return F.filter(F.transform(F.split(bits, ""), lambda b, i: F.when(b == "1", i)), lambda i: i.isNotNull())


def bits_to_bytes(bits: Column) -> Column:
    """A bit string, highest bit first, as bytes; its length is a multiple of 8 (OP-63)."""
    octets = F.sequence(F.lit(0), (F.length(bits) / 8 - 1).cast("int"))
    return F.unhex(F.array_join(F.transform(octets, lambda i: F.lpad(F.conv(F.substr(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), ""))


def all_zero(b: Column) -> Column:
    """Whether every byte is zero; true of no bytes (OP-65)."""
    return F.ltrim(F.hex(b), F.lit("0")) == ""


def varint_size(n: Column) -> Column:
    """Bytes of a non-negative number as a varint of 7 bits each (OP-66)."""
    size = F.lit(10)
    size = F.when(n >= 0, 9).otherwise(size)
    for k in range(8, 0, -1):
        size = F.when(n < (1 << (7 * k)), k).otherwise(size)
    return F.when(n < 0, 10).otherwise(size)


def varint(n: Column) -> Column:
    """A number's varint bytes, low bits first; negative ones take ten (OP-66)."""
    size = varint_size(n)
    octet = lambda i: F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127))
    return F.unhex(F.concat(*[F.when(size > i, F.lpad(F.hex(F.when(size > i + 1, octet(i).bitwiseOR(F.lit(128))).otherwise(octet(i))), 2, "0")).otherwise("") for i in range(10)]))


def varint_value(b: Column) -> Column:
    """The number of varint bytes."""
    octets = F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.conv(F.hex(F.substr(b, i, F.lit(1))), 16, 10).cast("long"))
    return F.aggregate(F.transform(octets, lambda o, i: F.call_function("shiftleft", o.bitwiseAND(F.lit(127)), (i * 7).cast("int"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def length_prefixed(b: Column) -> Column:
    """Bytes behind their length as a varint (OP-66)."""
    return F.concat(varint(F.length(b).cast("long")), b)


def content_hash(b: Column) -> Column:
    """31 times the hash so far plus each signed byte, from the length on, in 32 bits; 0 becomes 1 (OP-68)."""
    octets = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), lambda i: i <= F.length(b)), lambda i: F.conv(F.hex(F.substr(b, i, F.lit(1))), 16, 10).cast("long"))
    h = F.aggregate(octets, F.length(b).cast("long"), lambda s, x: (s * 31 + x - F.when(x > 127, 256).otherwise(0)).bitwiseAND(F.lit(WORD)))
    return F.when(signed32(h) == 0, F.lit(1)).otherwise(signed32(h))


def block_start(n: Column, block: int) -> Column:
    """The last multiple of ``block`` at or below (OP-71)."""
    return n - F.pmod(n, F.lit(block))


def block_end(n: Column, block: int) -> Column:
    """The first multiple of ``block`` at or above (OP-71)."""
    return block_start(n + (block - 1), block)


def lcm(a: int, b: int) -> int:
    """The least common multiple of two block sizes (OP-71)."""
    return math.lcm(a, b)


def value_offset(slot: Column, record: int = 4096) -> Column:
    """Where a slot's value begins (OP-70)."""
    return slot * record


def file_name(number: Column, suffix: str) -> Column:
    """Six digits or more, a dot and a suffix (OP-29)."""
    return F.format_string(f"%06d.{suffix}", number)


def file_number(name: Column) -> Column:
    """The number in a file name; null if it is not one of the store's (OP-29)."""
    digits = F.regexp_extract(name, r"^(\d{6,})\.(log|log2|keyLog|sst|list)$", 1)
    return F.when(digits != "", digits.cast("long"))


def file_kind(name: Column) -> Column:
    """The suffix of a file name; null if it is not one of the store's (OP-29)."""
    kind = F.regexp_extract(name, r"^\d{6,}\.(log|log2|keyLog|sst|list)$", 1)
    return F.when(kind != "", kind)
