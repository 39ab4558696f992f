"""Sets of small integers packed into BIGINT words.

Grid columns keep the layers of one (i, j) as bits, mask rows keep the cells of one
row as bits. A word row replaces up to 62 cell rows in every shuffle, and set logic
becomes ``bit_or`` / ``bit_and`` aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 62
FULL = (1 << WORD) - 1


def shift_left(value: Column, count: Column) -> Column:
    return F.call_function("shiftleft", value, count.cast("int"))


def shift_right(value: Column, count: Column) -> Column:
    return F.call_function("shiftright", value, count.cast("int"))


def long_lit(value: int) -> Column:
    return F.lit(value).cast("long")


def bit(position: Column) -> Column:
    """Single bit of a position inside its word."""
    return shift_left(long_lit(1), position)


def word_of(position: Column) -> Column:
    return F.floor(position / WORD).cast("int")


def bit_in_word(position: Column) -> Column:
    """Single bit of an absolute, non-negative position."""
    return bit(position % WORD)


def ones(count: Column) -> Column:
    """The lowest ``count`` bits, ``count`` clipped to 0..62."""
    n = F.greatest(F.lit(0), F.least(F.lit(WORD), count))
    return shift_left(long_lit(1), n) - long_lit(1)


def range_bits(word: Column, low: Column, high: Column) -> Column:
    """Bits of the absolute range low..high (inclusive) that fall into ``word``."""
    base = word * WORD
    return ones(high - base + 1).bitwiseAND(F.bitwise_not(ones(low - base)))


def explode_bits(df: DataFrame, bits: str, word: str, position: str, wide: bool = False) -> DataFrame:
    """One row per set bit; ``position`` is absolute. Drops ``bits`` and ``word``.

    Narrow rows are exploded up to the highest set bit and filtered in generated code.
    ``wide`` picks the set positions first, so a wide row is copied only for them.
    """
    at = F.sequence(F.lit(0), F.lit(WORD - 1))
    is_set = lambda b: shift_right(F.col(bits), b).bitwiseAND(long_lit(1)) == 1
    if wide:
        kept = df.withColumn("_b", F.explode(F.filter(at, is_set)))
    else:
        # One more than the logarithm says, against its rounding; a word without bits has no rows.
        top = F.least(F.lit(WORD - 1), F.floor(F.log2(F.col(bits))).cast("int") + 1)
        top = F.when(F.col(bits) > 0, top).when(F.col(bits) < 0, F.lit(WORD - 1))
        kept = df.withColumn("_b", F.explode(F.sequence(F.lit(0), top))).filter(is_set(F.col("_b")))
    return kept.withColumn(position, (F.col(word) * WORD + F.col("_b")).cast("int")).drop("_b", bits, word)
