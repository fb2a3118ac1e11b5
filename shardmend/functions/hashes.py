"""Small hashes of texts and payloads as column expressions: two halves of 32 bits in base 36."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardmend.functions.payload import latin
from shardmend.functions.prng import multiply32

# Where the halves start and what they are multiplied by.
FIRST, SECOND, PAYLOAD_SECOND = 0x811C9DC5, 0x01000193 ^ 0x5BD1E995, 0x9747B28C
FACTOR_A, FACTOR_B = 0x01000193, 0x5BD1E995
_LOW = 0xFFFFFFFF


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def _start(a: Column, b: Column) -> Column:
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))


def text_hash(text: Column) -> Column:
    """The hash of a text, by code points."""

    def step(h: Column, c: Column) -> Column:
        b = multiply32(h["b"].bitwiseXOR(c), FACTOR_B)
        return _start(multiply32(h["a"].bitwiseXOR(c), FACTOR_A), b.bitwiseXOR(F.shiftright(b, 15)))

    return F.aggregate(_codes(text), _start(F.lit(FIRST), F.lit(SECOND)), step, lambda h: F.concat(base36(h["a"]), base36(h["b"])))


def payload_hash(b: Column) -> Column:
    """The hash of a payload, which ends in its length."""
    size = F.length(b).cast("long")

    def step(h: Column, c: Column) -> Column:
        second = multiply32((h["b"] + c).bitwiseAND(F.lit(_LOW)), FACTOR_B).bitwiseXOR(F.shiftright(h["b"], 13))
        return _start(multiply32(h["a"].bitwiseXOR(c), FACTOR_A), second)

    whole = F.aggregate(_codes(latin(b)), _start(F.lit(FIRST).cast("long").bitwiseXOR(size), F.lit(PAYLOAD_SECOND)), step, lambda h: F.concat(base36(h["a"]), base36(h["b"])))
    return F.concat(whole, base36(size))


def has_hash(b: Column, expected: Column) -> Column:
    """Whether a payload has a hash; only those of the length that it ends in are read."""
    return F.when(expected.endswith(base36(F.length(b).cast("long"))), payload_hash(b) == expected).otherwise(False)
