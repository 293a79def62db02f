"""The Verhoeff checksum as Column expressions. Its tables follow from the dihedral group of the pentagon and one permutation."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the permutation whose powers act on the digits by position.
PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def times(a: int, b: int) -> int:
    """Product in the dihedral group of ten elements: 0 to 4 turn, 5 to 9 turn and flip."""
    flip, turn = a >= 5, (a - b if a >= 5 else a + b) % 5
    return turn + 5 * (flip != (b >= 5))


def _powers() -> list[list[int]]:
    rows = [list(range(10))]
    while len(rows) < 8:
        rows.append([PERMUTATION[x] for x in rows[-1]])
    return rows


PRODUCT = [times(a, b) for a in range(10) for b in range(10)]
POWERS = [x for row in _powers() for x in row]
INVERSE = [next(b for b in range(10) if times(a, b) == 0) for a in range(10)]


@lru_cache(1)
def _decimals() -> tuple[str, str]:
    """All Unicode decimal digits and the ASCII digit of each."""
    found = [(chr(c), unicodedata.decimal(chr(c))) for c in range(128, 0x110000) if unicodedata.decimal(chr(c), None) is not None]
    return "".join(c for c, _ in found), "".join(str(d) for _, d in found)


def ascii_digits(number: Column) -> Column:
    """Decimal digits of any script as ASCII ones."""
    return F.when(number.rlike(r"^[\x00-\x7f]*\z"), number).otherwise(F.translate(number, *_decimals()))


def digits_only(text: Column) -> Column:
    """Without white space and hyphens."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f-]", "")


def _table(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def _fold(number: Column, first: int) -> Column:
    turned = F.transform(F.split(F.reverse(ascii_digits(number)), ""), lambda d, i: _table(POWERS, (i + first) % 8 * 10 + d.cast("int")))
    return F.aggregate(turned, F.lit(0), lambda c, x: _table(PRODUCT, c * 10 + x))


def verhoeff_valid(number: Column) -> Column:
    """Whether a string of digits, check digit included, passes. False for anything else, and for the empty string; null for null."""
    return F.when(number.rlike(r"^\p{Nd}+\z"), _fold(number, 0) == 0).when(number.isNotNull(), F.lit(False))


def verhoeff_digit(number: Column) -> Column:
    """The check digit of a string of digits; anything else raises."""
    good = number.isNull() | number.rlike(r"^\p{Nd}+\z")
    return F.when(good, F.when(number.isNotNull(), _table(INVERSE, _fold(number, 1)).cast("string"))).otherwise(F.raise_error(F.lit("input must be all digits")).cast("string"))


def with_check_digit(number: Column) -> Column:
    """A number of twelve digits from eleven, the first from 2 to 9, as synthetic identifiers are made."""
    return F.concat(number, verhoeff_digit(number))


def grouped(number: Column) -> Column:
    """Twelve digits as 4-4-4."""
    return F.concat_ws(" ", F.substring(number, 1, 4), F.substring(number, 5, 4), F.substring(number, 9, 1000))


def corrupted(number: Column, position: int = 5) -> Column:
    """One digit raised by 1 modulo 10: always an invalid checksum."""
    return F.overlay(number, ((F.substring(number, position + 1, 1).cast("int") + 1) % 10).cast("string"), position + 1)
