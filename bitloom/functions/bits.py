"""Bit-string expressions. A descriptor is a set of 32-bit words, each a long column, as 64-bit words set the sign bit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32


def binarise(vector: str, bits: int = 64) -> list[Column]:
    """Words of the signs of a float vector: bit i of the string is set where component i is positive.

    Each word is one SQL expression, as building it operator by operator takes longer than running it on a small table.
    """
    return [F.expr(" | ".join(f"if(`{vector}`[{start + k}] > 0, {1 << k}L, 0L)" for k in range(min(WORD, bits - start)))) for start in range(0, bits, WORD)]


def with_words(df: DataFrame, vector: str = "embedding", bits: int = 64, prefix: str = "w") -> DataFrame:
    return df.select("*", *[w.alias(f"{prefix}{k}") for k, w in enumerate(binarise(vector, bits))])


def packed(words: Sequence[Column]) -> list[Column]:
    """Two words in one long each, the first in its low half; the same bits differ, and half the longs are compared."""
    pairs = [words[k : k + 2] for k in range(0, len(words), 2)]
    return [p[0] if len(p) == 1 else F.shiftleft(p[1], WORD).bitwiseOR(p[0]) for p in pairs]


def hamming(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Differing bits of two descriptors given word by word; unrolled, so that it stays in generated code."""
    return reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)]).cast("int")


def hamming_arrays(a: Column, b: Column) -> Column:
    """The same for descriptors held as arrays of words of any length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def popcount(words: Sequence[Column]) -> Column:
    return reduce(add, [F.bit_count(w) for w in words]).cast("int")


def bit(words: Sequence[Column], position: int) -> Column:
    return F.shiftrightunsigned(words[position // WORD], position % WORD).bitwiseAND(F.lit(1)).cast("int")


def gather(words: Sequence[Column], positions: Sequence[int]) -> Column:
    """The hash whose bit i is the descriptor's bit positions[i]; at most 32 positions."""
    if len(positions) > WORD:
        raise ValueError("a hash has 32 bits at most")
    return reduce(Column.bitwiseOR, [F.shiftleft(bit(words, p).cast("long"), i) for i, p in enumerate(positions)])


def pack_bytes(data: Sequence[Column]) -> Column:
    """A big-endian word of four byte columns: the first is the highest."""
    return reduce(Column.bitwiseOR, [F.shiftleft(b.cast("long"), 8 * (3 - k)) for k, b in enumerate(data)])


def unpack_bytes(word: Column) -> list[Column]:
    return [F.shiftrightunsigned(word, 8 * (3 - k)).bitwiseAND(F.lit(255)).cast("int") for k in range(4)]


def byte_order_position(byte: int, bit_of_byte: int) -> tuple[int, int]:
    """(word, shift) of a bit counted by bytes, when words are big-endian."""
    return byte // 4, (3 - byte % 4) * 8 + bit_of_byte


def rendered(words: Sequence[Column]) -> Column:
    """Bits as text, the first bit first; words apart by a space."""
    return F.concat_ws(" ", *[F.reverse(F.lpad(F.bin(w), WORD, "0")) for w in words])


def support(positions: Sequence[Sequence[int]], words: int) -> list[int]:
    """Which bits any of the hash functions reads, as words: the OR of their masks."""
    out = [0] * words
    for p in {p for ps in positions for p in ps}:
        out[p // WORD] |= 1 << p % WORD
    return out
