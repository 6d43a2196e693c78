"""Relevance: term frequency, inverse document frequency, length norms kept in one byte, query norm."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_norm(byte: int) -> float:
    """The value of a norm byte: three exponent-like steps a factor of two, from the fifth bit up."""
    return 0.0 if byte == 0 else (1 + (byte & 3) / 4) * 2.0 ** (96 + (byte >> 2) - 127)


NORMS = [decode_norm(b) for b in range(256)]


def encode_norm(value: float) -> int:
    """The smallest byte whose value is at least the given one."""
    return next((b for b, v in enumerate(NORMS) if v >= value), 255) if value > 0 else 0


def encode_norm_column(value: Column) -> Column:
    """The same by arithmetic: the power of two below the value (put right where the logarithm is rounded), and quarters of it, rounded up."""
    guess = F.floor(F.log2(value))
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.when(power(guess) > value, guess - 1).when(power(guess + 1) <= value, guess + 1).otherwise(guess)
    byte = 4 * (exponent + 31) + F.ceil((value / power(exponent) - 1) * 4)
    return F.when(value > 0, F.greatest(F.lit(1), F.least(byte, F.lit(255))).cast("int")).otherwise(F.lit(0))


def decode_norm_column(byte: Column) -> Column:
    power = F.pow(F.lit(2.0), 96 + F.shiftright(byte, 2) - 127)
    return F.when(byte == 0, F.lit(0.0)).otherwise((1 + byte.bitwiseAND(F.lit(3)) / 4) * power)


@dataclass(frozen=True)
class Similarity:
    """The scoring functions; override any of them. coord is off unless asked for."""

    coord_enabled: bool = False

    def tf(self, freq: Column) -> Column:
        return F.sqrt(freq)

    def idf(self, df: int, n: int) -> float:
        return 1 + math.log(n / (df + 1)) if n else 0.0

    def idf_column(self, df: Column, n: int) -> Column:
        return 1 + F.log(F.lit(float(n)) / (df + 1)) if n else F.lit(0.0)

    def length_norm(self, length: Column) -> Column:
        return 1 / F.sqrt(length.cast("double"))

    def query_norm(self, sum_of_squares: float) -> float:
        return 1 / math.sqrt(sum_of_squares) if sum_of_squares else 0.0

    def sloppy_freq(self, distance: int) -> float:
        return 1 / (1 + distance)

    def coord(self, overlap: int, most: int) -> float:
        return overlap / most
