"""Scalar functions, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ALL_ONES = 0xFFFFFFFF
#: FNV's primes and starts.
FNV = {32: (16777619, 2166136261), 64: (1099511628211, 14695981039346656037)}


def raw_crc(column: Column) -> Column:
    """CRC-32 from all ones and without the final complement, over a value's bytes (numbers: as decimal text)."""
    return F.lit(ALL_ONES) - F.crc32(column.cast("string").cast("binary"))


def raw_crc_bytes(column: Column) -> Column:
    """The same over binary."""
    return F.lit(ALL_ONES) - F.crc32(column)


def little_endian(column: Column, size: int = 8) -> Column:
    """A whole number's bytes, lowest first."""
    digits = F.lpad(F.hex(column.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)]))


def byte_values(column: Column) -> Column:
    """The bytes of a binary as an array of numbers."""
    digits = F.hex(column)
    return F.when(F.length(digits) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("long")))


def floor_div(column: Column, by: int) -> Column:
    """Whole numbers throughout: exact for all of 64 bits, and towards minus infinity, unlike a division of doubles."""
    return F.call_function("div", column - F.pmod(column, F.lit(by)), F.lit(by))


def fnv1_32(column: Column) -> Column:
    """FNV-1 of a binary: multiply, then xor with the byte."""
    prime, start = FNV[32]
    return F.aggregate(byte_values(column), F.lit(start), lambda h, b: (h * prime).bitwiseAND(ALL_ONES).bitwiseXOR(b))


def fnv1_64(column: Column) -> Column:
    """FNV-1 of a binary in 64 bits, as a signed number. The state is two halves, as no product of theirs overflows."""
    prime, start = FNV[64]
    above, below = prime >> 32, prime & ALL_ONES
    low, high = (lambda s: s["low"]), (lambda s: s["high"])

    def step(s: Column, b: Column) -> Column:
        product = low(s) * below
        upper = high(s) * below + low(s) * above + F.shiftrightunsigned(product, 32)
        return F.struct(upper.bitwiseAND(ALL_ONES).alias("high"), product.bitwiseAND(ALL_ONES).bitwiseXOR(b).alias("low"))

    first = F.struct(F.lit(start >> 32).cast("long").alias("high"), F.lit(start & ALL_ONES).cast("long").alias("low"))
    return F.aggregate(byte_values(column), first, step, lambda s: F.shiftleft(high(s), 32).bitwiseOR(low(s)))


def row_id(page: Column, slot: Column, size: Column) -> Column:
    """A place as one value; its parts are fields."""
    return F.struct(page.cast("long").alias("page"), slot.cast("int").alias("slot"), size.cast("long").alias("size"))


def type_and_size(column: Column) -> Column:
    """A value's type by name, and its bytes (texts and binaries: of the value; else as text)."""
    return F.struct(F.typeof(column).alias("type"), F.octet_length(column.cast("string")).cast("long").alias("size"))


def xor_folded(hash32: Column, bits: int) -> Column:
    """A 32-bit hash folded to fewer bits: the upper part is xored onto the lower."""
    return F.shiftrightunsigned(hash32, bits).bitwiseXOR(hash32.bitwiseAND((1 << bits) - 1)).bitwiseAND((1 << bits) - 1)


def linear_bucket(crc: Column, bits: int, next_split: int) -> Column:
    """The bucket of a linear hash table that is split up to ``next_split``."""
    low = crc.bitwiseAND((1 << bits - 1) - 1)
    return F.when(low < next_split, crc.bitwiseAND((1 << bits) - 1)).otherwise(low)


def partition_of(column: Column, partitions: int, factor: int = 31) -> Column:
    """A partition from 1 on, by a multiplicative hash over the bytes."""
    h = F.aggregate(byte_values(column.cast("string").cast("binary")), F.lit(0).cast("long"), lambda h, b: (h * factor + b).bitwiseAND(ALL_ONES))
    return F.pmod(h, F.lit(partitions)) + 1


def log2_floor(column: Column) -> Column:
    """The highest set bit's place; 0 for what is not positive. Exact, unlike a logarithm of doubles."""
    return F.when(column <= 0, 0).otherwise(F.length(F.bin(column.cast("long"))) - 1)


def power_of_two_below(column: Column) -> Column:
    """The largest power of two that is no larger."""
    return F.when(column <= 0, F.lit(0).cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2.0), log2_floor(column)).cast("long"))


def uri_escaped(column: Column) -> Column:
    """Percent-encoding with %20 for spaces."""
    return F.replace(F.url_encode(column), F.lit("+"), F.lit("%20"))


def uri_unescaped(column: Column) -> Column:
    return F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))


def tokens(column: Column, delimiters: str) -> Column:
    """Parts between any of the delimiter characters; empty parts are dropped."""
    return F.filter(F.split(column, _any_of(delimiters), -1), lambda x: x != "")


def tokens_with_empty(column: Column, delimiters: str) -> Column:
    return F.split(column, _any_of(delimiters), -1)


def _any_of(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in characters) + "]"


def only_of(column: Column, characters: str) -> Column:
    """Whether the text consists of the given characters alone."""
    return column.rlike(f"^{_any_of(characters)}*$")


def tuple_text(*columns: str | Column) -> Column:
    """(a,b,c)"""
    return F.concat(F.lit("("), F.concat_ws(",", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]), F.lit(")"))


def key_value_text(key: Column, value: Column) -> Column:
    """The key alone where the value is empty, else both with a comma."""
    return F.when(F.length(value) == 0, key).otherwise(F.concat_ws(",", key, value))


def calendar_days(year: Column, week: Column, day: Column) -> Column:
    """Days of a calendar with 7-day weeks and 52-week years."""
    return year * 364 + week * 7 + day


def calendar_add(year: Column, week: Column, day: Column, days: Column) -> Column:
    """Year, week and day after so many days."""
    at = calendar_days(year, week, day) + days
    return F.struct(floor_div(at, 364).alias("year"), floor_div(F.pmod(at, F.lit(364)), 7).alias("week"), F.pmod(at, F.lit(7)).alias("day"))


def retail_price(part: Column) -> Column:
    """The price of a part by its number, in hundredths, in whole numbers throughout (fixed values: the formula's numbers)."""
    return 100 * floor_div(90000 + F.pmod(floor_div(part, 10), F.lit(20001)) + 100 * F.pmod(part, F.lit(1000)), 100)


def rounded_down(column: Column, quantum: int) -> Column:
    return column - F.pmod(column, F.lit(quantum))


def rounded_up(column: Column, quantum: int) -> Column:
    return column + F.pmod(quantum - F.pmod(column, F.lit(quantum)), F.lit(quantum))


def synthetic_columns(i: Column) -> list[Column]:
    """Ten columns of different run lengths from a row number (run lengths are fixed values)."""
    runs = (1, 65536, 12514500, 10000000, 65536, 12514500, 10000000, 65536, 12514500, 10000000)
    return [floor_div(i, n).alias(f"c{k}") for k, n in enumerate(runs)]
