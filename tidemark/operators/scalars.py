"""Columns of single values: codes and limits, clocks of headlines, combined forecasts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.panel import EPS, safe_div

#: Daily limits in per cent by kind of share, and the prefixes of codes with the wide one.
SPECIAL_LIMIT, WIDE_LIMIT, LIMIT = 4.5, 19.5, 9.5
WIDE_PREFIXES = ("300", "301", "688", "689")
#: Formats in which publishing times are given; the last two have no clock.
CLOCKS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm")
DAYS = ("yyyy-MM-dd", "yyyyMMdd")


def bare_code(text: Column) -> Column:
    """The six digits of a share's code, NULL without."""
    return F.nullif(F.regexp_extract(text, r"(\d{6})", 1), F.lit(""))


def limit_pct(code: Column, name: Column) -> Column:
    """The daily limit of a share: narrow for names marked ST (blanks set aside) or as leaving the market, wide for growth boards."""
    wide = F.substring(code, 1, 3).isin(*WIDE_PREFIXES)
    known = F.coalesce(name, F.lit(""))
    special = F.upper(F.replace(known, F.lit(" "), F.lit(""))).contains("ST") | known.contains("退")
    return F.when(special, SPECIAL_LIMIT).when(wide, WIDE_LIMIT).otherwise(LIMIT)


def publish_clock(text: Column) -> tuple[Column, Column]:
    """Time and quality (``timestamp``, ``date_only`` or NULL) of a publishing time in any of the known formats."""
    at = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in CLOCKS))
    day = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DAYS))
    return F.coalesce(at, day), F.when(at.isNotNull(), "timestamp").when(day.isNotNull(), "date_only")


def title_hash(title: Column) -> Column:
    """Fingerprint of a title, blanks set aside."""
    return F.sha1(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", "").cast("binary"))


def lexicon_score(text: Column, good: list[str], bad: list[str]) -> Column:
    """Share by which good words outnumber bad ones among those found, from -1 to 1; 0 without any."""
    count = lambda words: sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    g, b = count(good), count(bad)
    return F.coalesce((g - b) / F.nullif(g + b, F.lit(0)), F.lit(0.0))


def compound_pct(*legs: Column) -> Column:
    """Per cent of one after the other."""
    total = F.lit(1.0)
    for x in legs:
        total = total * (1 + x / 100)
    return (total - 1) * 100


def remaining_pct(forecast: Column, so_far: Column) -> Column:
    """What a forecast leaves after a part of it has come, in per cent."""
    return (safe_div(1 + forecast / 100, 1 + so_far / 100) - 1) * 100


def remaining_variance(variance: Column, so_far: Column) -> Column:
    """The variance of what ``remaining_pct`` leaves: divided by the square of the growth so far, 1e-12 at least; unchanged where that is not known or nought."""
    p, grown = F.greatest(F.coalesce(variance, F.lit(1.0)), F.lit(1e-6)), 1 + so_far / 100
    return F.when(F.abs(grown) > EPS, F.greatest(F.lit(1e-12), p / F.nullif(grown * grown, F.lit(0.0)))).otherwise(p)


def inverse_variance_shares(clock: Column, day: Column, so_far: Column) -> tuple[Column, Column]:
    """Shares of two forecasts in proportion to 1 / variance, the day's first brought to the time left; NULL where a variance is missing or not above 1e-12."""
    usable = (clock > EPS) & (day > EPS)
    a, b = 1 / F.nullif(clock, F.lit(0.0)), 1 / remaining_variance(day, so_far)
    return F.when(usable, a / (a + b)), F.when(usable, b / (a + b))


def fused(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are there; NULL without any."""
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    return F.when(weight > 0, sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0)) / weight)


def kelly(win_rate: Column, gain_to_loss: Column, cap: float = 0.25, floor: float = 0.05, default: float = 0.15) -> Column:
    """Half the Kelly fraction within ``floor`` and ``cap``, to four places; ``default`` without a ratio above 0 or a rate between 0 and 1."""
    usable = (win_rate > 0) & (win_rate < 1) & (gain_to_loss > 0)
    half = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (win_rate * gain_to_loss - (1 - win_rate)) / gain_to_loss)) / 2
    return F.when(usable, F.round(F.greatest(F.lit(floor), F.least(F.lit(cap), half)), 4)).otherwise(F.lit(default))
