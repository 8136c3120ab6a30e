"""Check digits as Column expressions. Fixed lengths are unrolled arithmetic; the rest are folds. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(text: Column, i: int) -> Column:
    return F.ascii(F.substring(text, i + 1, 1)) - 48


def _luhn_tail(text: Column, offset: int, total: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), F.length(text)),
        total,
        lambda acc, i: acc
        + F.when(
            (F.length(text) - i + offset) % 2 == 1,
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.ascii(F.substr(text, i, F.lit(1))) - 47),
        ).otherwise(F.ascii(F.substr(text, i, F.lit(1))) - 48),
    )


def luhn(text: Column) -> Column:
    """Digits only, not empty, and the doubled-from-the-right sum ends in 0."""
    return F.when(text.rlike("^[0-9]+$"), _luhn_tail(text, 0, F.lit(0)) % 10 == 0).otherwise(F.when(text.isNotNull(), F.lit(False)))


def npi(text: Column) -> Column:
    """Ten digits that pass Luhn behind the prefix 80840, whose own sum is 24."""
    total = F.lit(24)
    for i in range(10):
        d = _digit(text, i)
        total = total + (d if i % 2 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return F.when(text.rlike("^[0-9]{10}$"), total % 10 == 0).otherwise(F.when(text.isNotNull(), F.lit(False)))


def aba(text: Column) -> Column:
    """Nine digits with a bank district prefix and the 3-7-1 weighted sum ending in 0."""
    weights = (3, 7, 1) * 3
    total = sum((w * _digit(text, i) for i, w in enumerate(weights)), F.lit(0))
    prefix = 10 * _digit(text, 0) + _digit(text, 1)
    ranged = prefix.between(0, 12) | prefix.between(21, 32) | prefix.between(61, 72) | (prefix == 80)
    return F.when(text.rlike("^[0-9]{9}$"), ranged & (total % 10 == 0)).otherwise(F.when(text.isNotNull(), F.lit(False)))


def dea(text: Column) -> Column:
    """Two characters and seven digits, of which the last is the last digit of odd + 2 * even places."""
    total = sum(((2 if i % 2 else 1) * _digit(text, i + 2) for i in range(6)), F.lit(0))
    return F.when(text.rlike("^..[0-9]{7}$"), total % 10 == _digit(text, 8)).otherwise(F.when(text.isNotNull(), F.lit(False)))


def iban(text: Column) -> Column:
    """15 to 34 letters and digits whose rotation by four is 1 modulo 97, letters counting from 10."""
    turned = F.upper(F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.when(text.rlike("^[A-Za-z0-9]{15,34}$"), rest == 1).otherwise(F.when(text.isNotNull(), F.lit(False)))
