"""Fixed-length bitsets as arrays of 64-bit words, as Column expressions. Bit 0 is the lowest bit of the first word.

Indexes are checked: outside 0..n-1 is an error. Sizes of two operands must be equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), (n + 63) // 64)


def from_positions(positions: Column, n: int) -> Column:
    """Words with the bits of an array of distinct positions set."""
    words = F.transform(F.sequence(F.lit(0), F.lit((n + 63) // 64 - 1)), lambda w: F.aggregate(F.filter(positions, lambda p: F.floor(p / 64) == w), F.lit(0).cast("bigint"), lambda a, p: a.bitwiseOR(_one(p % 64))))
    return words


def _one(shift: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), shift.cast("int"))


def _checked(i: Column, n: int) -> Column:
    return F.when((i >= 0) & (i < n), i).otherwise(F.raise_error(F.concat(F.lit("bit index out of range: "), i.cast("string"))).cast("int"))


def test(words: Column, i: Column, n: int) -> Column:
    i = _checked(i, n)
    return F.getbit(F.element_at(words, (F.floor(i / 64) + 1).cast("int")), (i % 64).cast("int")).cast("int")


def test_slice(words: Column, start: int, stop: int, step: int = 1) -> Column:
    """Bits start, start+step, ... below stop as an array of 0 and 1."""
    if start >= stop:
        return F.array().cast("array<int>")
    return F.transform(F.sequence(F.lit(start), F.lit(stop - 1), F.lit(step)), lambda i: F.getbit(F.element_at(words, (F.floor(i / 64) + 1).cast("int")), (i % 64).cast("int")).cast("int"))


def put(words: Column, i: Column, value: Column, n: int) -> Column:
    """One bit set or cleared."""
    i = _checked(i, n)
    one = _one(i % 64)
    return F.transform(words, lambda w, k: F.when(k != F.floor(i / 64), w).when(value != 0, w.bitwiseOR(one)).otherwise(w.bitwiseAND(F.bitwise_not(one))))


def put_bits(words: Column, start: int, bits: str, n: int) -> Column:
    """A run of bits from text of 0 and 1, its first character at ``start``; a leading 0b is ignored."""
    bits = bits[2:] if bits[:2] == "0b" else bits
    if start < 0 or start + len(bits) > n:
        raise IndexError("bits reach beyond the set")
    for k, b in enumerate(bits):
        words = put(words, F.lit(start + k), F.lit(int(b)), n)
    return words


def to_bits(words: Column, n: int) -> Column:
    """Text of 0 and 1, bit 0 first."""
    return F.array_join(F.transform(test_slice(words, 0, n), lambda b: b.cast("string")), "")


def bitwise(a: Column, b: Column, oper: str) -> Column:
    """and, or, xor of two sets of one size."""
    f = {"and": lambda x, y: x.bitwiseAND(y), "or": lambda x, y: x.bitwiseOR(y), "xor": lambda x, y: x.bitwiseXOR(y)}[oper]
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("bitsets differ in size")).cast("array<bigint>"))


def insert(bits: Column, index: int, value: Column) -> Column:
    """Text of bits with others spliced in."""
    return F.concat(F.substring(bits, 1, index), value, F.substr(bits, F.lit(index + 1)))


def count(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))
