"""Column functions over panels: series of one entity in time order, and cross-sections of one date.

They stand for the operators of a factor expression: ``mean(close / ref(close, 1), 5)`` is written with Python and Column operators,
so Spark's own analyzer checks and plans it. Missing values are NULL; a rolling value needs a full window of finite
values, else it is NULL. Standard deviation and variance are of the population, covariance is of the sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def refuse(rows: DataFrame, *names: str) -> None:
    """Raise if ``rows`` has a column that is about to be added: it would be overwritten."""
    if clash := sorted(set(names) & set(rows.columns)):
        raise ValueError(f"the table has columns of the names {clash} already")


def finite(x: Column) -> Column:
    """``x``, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_div(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``abs(b)`` is 1e-12 or less."""
    return F.when(F.abs(b) > EPS, a / b)


def rounded_to(x: Column, digits: int) -> Column:
    """``x`` rounded as the double that it is: halves of the scaled value go away from 0 (``round`` goes by the shortest decimal text instead)."""
    scaled = x.cast("double") * 10.0**digits
    near = F.rint(scaled)  # halves to even
    short = F.when((scaled > 0) & (scaled - near == 0.5), 1.0).when((scaled < 0) & (scaled - near == -0.5), -1.0).otherwise(0.0)
    return (near + short) / 10.0**digits


def pearson(x: Column, y: Column, window: WindowSpec | None = None) -> Column:
    """Correlation over the rows that have both, NULL where either does not vary (Spark's own divides by zero there)."""
    u, v = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(u, v), F.stddev_pop(u), F.stddev_pop(v)]
    c, a, b = (p.over(window) for p in parts) if window is not None else parts
    return c / F.nullif(a * b, F.lit(0.0))


class Panel:
    """Windows over a frame with one row per entity and date."""

    def __init__(self, code: str = "code", date: str = "date", section: str | None = None):
        self.code, self.date, self.section = code, date, section or date

    # Windows need a session, so they are made when they are used.
    @property
    def series(self) -> WindowSpec:
        return Window.partitionBy(self.code).orderBy(self.date)

    @property
    def day(self) -> WindowSpec:
        return Window.partitionBy(self.section)

    def frame(self, n: int) -> WindowSpec:
        return self.series.rowsBetween(-(n - 1), 0)

    def full(self, n: int, value: Column, *needs: Column) -> Column:
        """``value`` where all of ``needs`` are there in each of the last ``n`` rows."""
        ok = F.lit(True)
        for x in needs:
            ok = ok & (F.count(x).over(self.frame(n)) == n)
        return F.when(ok, value)

    def _roll(self, f: Callable[[Column], Column], x: Column, n: int) -> Column:
        x = finite(x.cast("double"))
        return self.full(n, f(x).over(self.frame(n)), x)

    def ref(self, x: Column, n: int) -> Column:
        """``x`` of n rows earlier; later for a negative n."""
        return F.lag(x, n).over(self.series) if n >= 0 else F.lead(x, -n).over(self.series)

    def mean(self, x: Column, n: int) -> Column:
        return self._roll(F.avg, x, n)

    def std(self, x: Column, n: int) -> Column:
        return self._roll(F.stddev_pop, x, n)

    def var(self, x: Column, n: int) -> Column:
        return self._roll(F.var_pop, x, n)

    def ts_max(self, x: Column, n: int) -> Column:
        return self._roll(F.max, x, n)

    def ts_min(self, x: Column, n: int) -> Column:
        return self._roll(F.min, x, n)

    def total(self, x: Column, n: int) -> Column:
        return self._roll(F.sum, x, n)

    def quantile(self, x: Column, n: int, p: float) -> Column:
        """Linearly interpolated quantile."""
        return self._roll(lambda c: F.percentile(c, p), x, n)

    def delta(self, x: Column, n: int) -> Column:
        return x - self.ref(x, n)

    def roc(self, x: Column, n: int) -> Column:
        return safe_div(x, self.ref(x, n)) - 1

    def ts_rank(self, x: Column, n: int) -> Column:
        """Share of the window below the current value, equal values counting half."""
        x = finite(x.cast("double"))
        values = F.collect_list(x).over(self.frame(n))
        less, equal = (F.size(F.filter(values, f)) for f in (lambda v: v < x, lambda v: v == x))
        return self.full(n, (less + equal / 2) / n, x)

    def rsv(self, x: Column, n: int) -> Column:
        """Place between the window's extremes; 0.5 where they coincide."""
        low, high = self.ts_min(x, n), self.ts_max(x, n)
        return F.when(high - low < EPS, F.lit(0.5)).otherwise((x - low) / (high - low))

    def corr(self, x: Column, y: Column, n: int) -> Column:
        flat = (self.std(x, n) < EPS) | (self.std(y, n) < EPS)
        return F.when(~flat, self.full(n, pearson(finite(x), finite(y), self.frame(n)), finite(x), finite(y)))

    def cov(self, x: Column, y: Column, n: int) -> Column:
        if n < 2:
            return F.lit(None).cast("double")
        return self.full(n, F.covar_samp(finite(x), finite(y)).over(self.frame(n)), finite(x), finite(y))

    # Cross-sections.

    def average_rank(self, x: Column, *by: str) -> Column:
        """Rank from 1 over the finite values of the section, equal values sharing the mean of theirs; NULL stays NULL."""
        x = finite(x.cast("double"))
        place = Window.partitionBy(self.section, *by)
        return F.when(x.isNotNull(), F.rank().over(place.orderBy(x.asc_nulls_last())) + (F.count(x).over(place.partitionBy(self.section, *by, x)) - 1) / 2)

    def cs_rank(self, x: Column) -> Column:
        x = finite(x.cast("double"))
        return self.average_rank(x) / F.count(x).over(self.day)

    def cs_zscore(self, x: Column) -> Column:
        """NULL with fewer than two finite values, 0 where they do not differ."""
        x = finite(x.cast("double"))
        n, sd = F.count(x).over(self.day), F.stddev_pop(x).over(self.day)
        return F.when((n >= 2) & x.isNotNull(), F.when(sd <= EPS, F.lit(0.0)).otherwise((x - F.avg(x).over(self.day)) / sd))

    def panel_zscore(self, x: Column, least: int = 2) -> Column:
        """As ``cs_zscore``, but finite values of a section that is too small or flat become 0."""
        x = finite(x.cast("double"))
        n, var = F.count(x).over(self.day), F.var_pop(x).over(self.day)
        usable = (n >= least) & (var > EPS)
        return F.when(x.isNotNull(), F.when(usable, (x - F.avg(x).over(self.day)) / F.sqrt(var)).otherwise(F.lit(0.0)))
