"""The record model: binary keys, their signed 64-bit form, groups by key prefix, and key orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a store holds: ``seq`` is the order of arrival, unique and rising.
KV = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("seq", T.LongType())])

KEY_BYTES = 8
#: Fixed value: bytes of a value record; offsets count in it.
VALUE_BYTES = 4096
#: Groups are the top GROUP_BITS bits of a key.
GROUP_BITS = 10
GROUPS = 1 << GROUP_BITS

ORDERS = ("unsigned", "signed", "live")


def long_to_key(n: Column) -> Column:
    """A signed long as 8 big-endian bytes (OP-54)."""
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def key_to_long(key: Column) -> Column:
    """8 big-endian bytes as a signed long (OP-54)."""
    return F.conv(F.hex(key), 16, -10).cast("long")


def group_of(key_long: Column, bits: int = GROUP_BITS) -> Column:
    """The group of a key: its top bits, 0 to 2**bits - 1 (OP-59)."""
    return F.shiftrightunsigned(key_long, 64 - bits).cast("int")


def hashed_key(n: Column) -> Column:
    """A key spread over all 64 bits: the first half of the md5 of the number as text, as a signed long."""
    return F.conv(F.substring(F.md5(n.cast("string")), 1, 16), 16, -10).cast("long")


def order_by(order: str, key_long: str | Column = "key_long") -> list[Column]:
    """Sort columns of one of the ORDERS.

    ``unsigned``: bytes ascending, the canonical one. ``signed``: two's complement ascending. ``live``: the group walk
    from the last group down to the middle, then from 0 up, signed inside each group; not monotone in the key.
    """
    k = F.col(key_long) if isinstance(key_long, str) else key_long
    if order == "unsigned":
        return [(k < 0).asc(), k.asc()]
    if order == "signed":
        return [k.asc()]
    if order == "live":
        g = group_of(k)
        return [(k >= 0).asc(), F.when(g >= GROUPS // 2, -g).otherwise(g).asc(), k.asc()]
    raise ValueError(f"order is one of {', '.join(ORDERS)}, not {order!r}")


def with_key_long(df: DataFrame) -> DataFrame:
    return df.withColumn("key_long", key_to_long(F.col("key")))
