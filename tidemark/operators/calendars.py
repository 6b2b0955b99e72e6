"""Trading days: weekdays that are no holidays. Holidays are a short list of dates, given as text.

The neighbours of a date are found by stepping over runs of days off, once for each distinct date: as many candidates are tried as the longest runs can hold, and the
distinct dates (days, however many rows) join the rows. A NULL date has no neighbours; further columns are kept, columns that would be overwritten refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.panel import refuse


def is_trading(date: Column, holidays: list[str]) -> Column:
    """Whether a date is a weekday and no holiday."""
    return (F.weekday(date) < 5) & ~date.isin(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.weekday(date) < 5


def _step(date: Column, holidays: list[str], way: int, n: int) -> Column:
    # Of so many days n trade: all holidays, and two weekend days for every week begun.
    most = 2 * n + 3 + 2 * len(holidays)
    days = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.date_add(date, k * way))
    return F.get(F.filter(days, lambda x: is_trading(x, holidays)), F.lit(n - 1))


def neighbours(rows: DataFrame, holidays: list[str], n: int = 1) -> DataFrame:
    """``rows`` (date, ...) with ``trading``, and the ``n``-th ``next`` and ``previous`` trading day, both other than the date."""
    if n < 1:
        raise ValueError(f"n={n}")
    refuse(rows, "trading", "next", "previous")
    date = F.col("date")
    days = rows.select("date").where(date.isNotNull()).distinct().withColumns({"trading": is_trading(date, holidays), "next": _step(date, holidays, 1, n), "previous": _step(date, holidays, -1, n)})
    return rows.join(days, "date", "left").select(*rows.columns, "trading", "next", "previous")


def trading_rows(rows: DataFrame, holidays: list[str]) -> DataFrame:
    """``rows`` of trading days."""
    return rows.where(is_trading(F.col("date"), holidays))
