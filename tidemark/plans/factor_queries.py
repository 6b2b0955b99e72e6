"""Scores of entities and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import factors
from tidemark.plans.panel_queries import c, daily, rounded
from tidemark.plans.registry import register
from tidemark.plans.sql import DAILY
from tidemark.sources import bars as B

_MOM = "case when {m} is null then 40 when {m} between 0 and 6 then 70 + {m} * 4 when {m} > 6 and {m} < 12 then 94 - ({m} - 6) * 6 when {m} >= -4 and {m} < 0 then 55 + {m} * 5 when {m} >= 12 then 40 else greatest(10, 40 + {m}) end"

PRICE = f"""with {DAILY}, a as (select *, close * volume as amount, row_number() over s as n, lag(close) over s as p, first(close) over (s rows between 3 preceding and current row) as f3, first(close) over (s rows between 5 preceding and current row) as f5 from bars window s as (partition by code order by date)),
b as (select *, case when n > 1 and f3 <> 0 then (close / f3 - 1) * 100 end as m3, case when n > 1 and f5 <> 0 then (close / f5 - 1) * 100 end as m5r, case when p is not null then greatest(high - low, abs(high - p), abs(low - p)) end as tr,
  case when p > 0 and close > 0 and amount > 0 then abs(close / p - 1) / amount end as im from a),
w as (select *, case when n > 5 then m5r else m3 end as m5, avg(tr) over (s rows between 4 preceding and current row) / close * 100 as atr, case when n >= 2 then avg(amount) over (s rows between 2 preceding and current row) / avg(amount) over (s rows between 9 preceding and current row) end as t,
  case when n >= 3 and p > 0 then abs(open / p - 1) * 100 end as g, list_sort(list_filter(list(im) over (s rows between 9 preceding and current row), lambda x: x is not null)) as ims, avg(im) over (s rows between 9 preceding and current row) as mean, case when open > 0 then (close / open - 1) * 100 end as d from b window s as (partition by code order by date)),
r as (select *, case when ims[len(ims) // 2 + 1] > 0 then ln(mean / ims[len(ims) // 2 + 1]) end as l, case when n >= 3 then (0.6 * greatest(m5, 0) + 0.3 * greatest(m3, 0) + 0.1 * greatest(d, 0)) end as raw from w)
select code, date, round(0.6 * {_MOM.format(m='m3')} + 0.4 * {_MOM.format(m='m5')}, 6) + 0.0 as momentum, cast(case when atr is null then 55 when atr <= 2.5 then 80 when atr <= 4.5 then 60 when atr <= 7 then 40 else 20 end as double) as volatility,
round(case when t between 0.75 and 1.8 then 62 + least(18, (t - 0.75) * 12) when t < 0.75 then greatest(25, 40 + (t - 0.75) * 30) when t <= 3 then 48 when t > 3 then 35 end, 1) as liquidity,
cast(case when g >= 7 then 35 when g >= 4 then 42 when g >= 2 then 48 when g is not null then 55 end as double) as gap_risk, cast(case when l <= -0.3 then 72 when l <= 0 then 62 when l <= 0.5 then 52 when l <= 1 then 42 when l is not null then 32 end as double) as illiquidity,
round(case when raw < 4 then 70 when raw < 6 then 55 - (raw - 4) * 5 when raw < 8 then 45 - (raw - 6) * 5 when raw < 12 then 35 - (raw - 8) * 3.75 when raw is not null then greatest(10, 20 - (raw - 12) * 2) end, 6) as overheat,
cast(case when raw < 4 then 1 when raw < 6 then 0.85 when raw < 8 then 0.6 when raw < 10 then 0.4 when raw < 12 then 0.25 when raw is not null then 0.15 end as double) as overheat_scale from r"""


@register("factor_price_scores", PRICE)
def factor_price_scores(spark, d):
    return rounded(factors.price_scores(daily(spark, d)), "code", "date")


#: Fundamentals made of the parts' numbers, with gaps.
_FUND = """f as (select p_partkey, case when p_size % 7 <> 0 then p_size * 1.5 - 5 end as pe, case when p_size % 5 <> 0 then p_retailprice / 300 - 2.9 end as pb, case when p_size % 11 <> 0 then exp(p_size / 5.0 + 20) end as market_cap,
  case when p_size % 3 <> 0 then p_size / 6.0 when p_size % 2 = 0 then p_size / 100.0 end as dividend_yield, case when p_size % 2 = 0 then p_retailprice - 940 end as profit_growth, case when p_size % 4 <> 1 then p_size - 20.0 end as revenue_growth, case when p_size % 13 <> 0 then p_retailprice / 20 - 30 end as roe from part)"""


@register(
    "factor_fundamental_scores",
    f"""with {_FUND}, g as (select *, case when pe > 0 then pe end as e, case when pb > 0 then pb end as b, ln(case when market_cap > 0 then market_cap end) as l, case when dividend_yield > 0 and dividend_yield < 0.5 then dividend_yield * 100 else dividend_yield end as y, coalesce(profit_growth, revenue_growth) as gr from f),
    h as (select *, 100 / e as ep from g)
    select p_partkey, case when e is not null or b is not null then cast(50 + case when e between 8 and 25 then 12 when e > 25 and e <= 40 then 4 when e > 60 then -12 when e < 5 then -6 else 0 end + case when b between 0.8 and 3 then 8 when b > 6 then -8 when b < 0.5 then -4 else 0 end as double) end as value,
    cast(case when l is null then null when l between 23.5 and 26.5 then 68 when l >= 22 and l <= 28 then 58 when l >= 20.5 and l <= 29.5 then 48 else 40 end as double) as size,
    cast(case when ep is null then null when ep between 4 and 8 then 70 when ep between 2.5 and 12 then 58 when ep between 1.5 and 18 then 48 when ep < 1.5 then 38 else 42 end as double) as earnings_yield,
    cast(case when y is null then null when y between 2 and 5 then 68 when y between 1 and 7 then 58 when y between 0.3 and 1 then 50 when y > 7 then 45 else 48 end as double) as dividend,
    cast(case when gr is null then null when gr >= 30 then 78 when gr >= 20 then 70 when gr >= 8 then 60 when gr >= 0 then 52 when gr >= -10 then 42 else 32 end as double) as growth,
    cast(case when roe is null then null when roe >= 20 then 68 when roe >= 12 then 60 when roe >= 5 then 53 else 40 end as double) as quality from h""",
    dates=(),
)
def factor_fundamental_scores(spark, d):
    size, price = c("p_size"), c("p_retailprice")
    f = B.read(spark, d, "part").select(
        "p_partkey", F.when(size % 7 != 0, size * 1.5 - 5).alias("pe"), F.when(size % 5 != 0, price / 300 - 2.9).alias("pb"), F.when(size % 11 != 0, F.exp(size / 5.0 + 20)).alias("market_cap"),
        F.when(size % 3 != 0, size / 6.0).when(size % 2 == 0, size / 100.0).alias("dividend_yield"), F.when(size % 2 == 0, price - 940).alias("profit_growth"), F.when(size % 4 != 1, size - 20.0).alias("revenue_growth"), F.when(size % 13 != 0, price / 20 - 30).alias("roe"),
    )
    return factors.fundamental_scores(f).select("p_partkey", "value", "size", "earnings_yield", "dividend", "growth", "quality")


@register("factor_weighted", f"with s as ({PRICE}) select code, date, round((momentum * 0.5 + coalesce(liquidity * 0.25, 0) + coalesce(gap_risk * 0.25, 0)) / (0.5 + case when liquidity is not null then 0.25 else 0 end + case when gap_risk is not null then 0.25 else 0 end), 7) as score from s")
def factor_weighted(spark, d):
    s = rounded(factors.price_scores(daily(spark, d)), "code", "date")
    return s.select("code", "date", F.round(factors.weighted({"momentum": 0.5, "liquidity": 0.25, "gap_risk": 0.25}), 7).alias("score"))
