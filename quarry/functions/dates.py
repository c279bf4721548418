"""Semester arithmetic and dates for display. The current day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import col

#: Portuguese names of the months.
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def half(day: Column | str) -> Column:
    return F.when(F.month(col(day)) <= 6, 1).otherwise(2)


def semester(day: Column | str, ahead: int = 0) -> Column:
    """Like 2024/1; `ahead` semesters later."""
    number = F.year(col(day)) * 2 + half(day) - 1 + ahead
    return F.concat_ws("/", F.floor(number / 2).cast("string"), (number % 2 + 1).cast("string"))


def next_offer(day: Column | str, parity: Column) -> Column:
    """The next semester, from the one after the day's, in which something of a parity (odd, even, both) is offered."""
    following = 3 - half(day)
    wait = F.when((parity == "both") | ((parity == "odd") & (following == 1)) | ((parity == "even") & (following == 2)), 1).otherwise(2)
    number = F.year(col(day)) * 2 + half(day) - 1 + wait
    return F.when(parity.isNotNull(), F.concat_ws("/", F.floor(number / 2).cast("string"), (number % 2 + 1).cast("string")))


def display(day: Column | str) -> Column:
    """Like 5 de maio de 2024."""
    names = F.array(*map(F.lit, MONTHS))
    return F.concat(F.dayofmonth(col(day)).cast("string"), F.lit(" de "), names[F.month(col(day)) - 1], F.lit(" de "), F.year(col(day)).cast("string"))
