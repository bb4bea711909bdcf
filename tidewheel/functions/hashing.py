"""Hashes of the routing and sharding rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Offset basis and prime of 64-bit FNV-1a; the prime is 2^40 + 435.
BASIS_HIGH, BASIS_LOW, PRIME_LOW, PRIME_SHIFT = 0xCBF29CE4, 0x84222325, 435, 8


def utf16_units(text: Column) -> Column:
    """UTF-16 code units of a text."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    count = F.length(digits) / 4
    at = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))


def fnv1a64(text: Column) -> Column:
    """64-bit FNV-1a over UTF-16 units as a signed long; two 32-bit limbs keep products in range."""
    mask = F.lit(0xFFFFFFFF)
    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("h"), F.lit(BASIS_LOW).cast("long").alias("l"))

    def step(state: Column, unit: Column) -> Column:
        low = state["l"].bitwiseXOR(unit)
        product = low * PRIME_LOW
        high = state["h"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, PRIME_SHIFT)
        return F.struct(high.bitwiseAND(mask).alias("h"), product.bitwiseAND(mask).alias("l"))

    return F.aggregate(utf16_units(text), start, step, lambda s: F.shiftleft(s["h"], 32).bitwiseOR(s["l"]))


def crc_shard(key: Column, shards: int) -> Column:
    """CRC-32 of the key's UTF-8 as a signed 32-bit number, modulo the number of shards, never negative."""
    crc = F.crc32(F.encode(key, "UTF-8"))
    signed = F.when(crc >= 1 << 31, crc - (1 << 32)).otherwise(crc)
    return F.pmod(signed, F.lit(shards).cast("long")).cast("int")
