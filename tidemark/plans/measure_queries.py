"""Measures of trades, curves and panels, and labels within the session."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from tidemark.functions.panel import EPS, rounded_to, safe_div
from tidemark.operators import backtest, measures, portfolio, scalars, session
from tidemark.plans.merge_queries import _FEATS, feats
from tidemark.plans.panel_queries import c, daily, rounded, ships
from tidemark.plans.registry import register
from tidemark.plans.research_queries import _RET, P, returns
from tidemark.plans.sql import DAILY, SHIPS
from tidemark.sources import bars as B

#: Overlapping trades of the daily bars, their returns cut off, with scores spread over 0 to 100.
_TRADES = f"""{DAILY}, t as (select code, date, close / nullif(open, 0) as ratio, close, lead(open, 1) over w as e, lead(open, 4) over w as x from bars window w as (partition by code order by date)),
tr as (select code, date, least(100, ratio * 40) as score, greatest(-60, least(80, (x / e - 1) * 100 - 0.2)) as r from t where ratio >= 0 and e > 1e-12 and x is not null and not (e / close - 1 >= 0.095))"""


def trades(spark, d):
    b = daily(spark, d).withColumn("ratio", safe_div(c("close"), c("open")))
    t = backtest.overlapping_trades(b, "ratio", 0.0, 3, 0.2).withColumn("ret_pct", portfolio.clamp(c("ret_pct"), -60, 80))
    t = t.where(c("entry") > EPS)  # from an entry of 0 there is no return, and limits would make one of it
    return t.join(b.select("code", "date", "ratio"), ["code", "date"]).withColumn("score", F.least(F.lit(100.0), c("ratio") * 40))


@register(
    "metric_trades",
    f"""with {_TRADES}, q as (select code, date, r, exp(sum(ln(1 + r / 100)) over (partition by code order by date)) as e from tr), p as (select *, greatest(1, max(e) over (partition by code order by date)) as p from q)
    select code, count(*) as n, round(avg(case when r > 0 then 100.0 else 0 end), 6) as win_pct, round(avg(r), 6) as mean_pct, round(round((exp(sum(ln(1 + r / 100))) - 1) * 100, 6), 4) as total_pct, round(greatest(0, max((p - e) / p * 100)), 6) as drawdown_pct,
    round(case when stddev_samp(r) > 1e-9 then avg(r) / stddev_samp(r) * sqrt(252.0 / 3) end, 6) as sharpe from p group by 1""",
    dates=(),
)
def metric_trades(spark, d):
    return rounded(measures.trade_metrics(trades(spark, d), "code", order=("date",), hold=3), "code", "n").withColumn("total_pct", rounded_to(c("total_pct"), 4))


@register(
    "metric_by_score",
    f"""with {_TRADES}, b as (select case when score < 55 then '<55' when score < 65 then '55-64' when score < 75 then '65-74' else '75+' end as bucket, r from tr where score >= 0)
    select bucket, count(*) as n, round(avg(case when r > 0 then 100.0 else 0 end), 6) as win_pct, round(avg(r), 6) as mean_pct from b group by 1""",
    dates=(),
)
def metric_by_score(spark, d):
    return rounded(measures.by_score(trades(spark, d)).drop("total_pct"), "bucket", "n")


@register(
    "metric_against_holding",
    f"""with {_TRADES}, h as (select code, (arg_max(close, date) / arg_min(close, date) - 1) * 100 as h from bars where close > 0 group by 1 having count(*) >= 2), m as (select code, (exp(sum(ln(1 + r / 100))) - 1) * 100 as t from tr group by 1)
    select code, round(h, 4) as hold_pct, round(t, 4) as trades_pct, round(t - h, 4) as excess_pct from h left join m using (code)""",
    dates=(),
)
def metric_against_holding(spark, d):
    return rounded(measures.against_holding(daily(spark, d), trades(spark, d)), "code", digits=4)


@register(
    "risk_calmar",
    f"""with {_RET}, e as (select code, date, exp(sum(ln(1 + greatest(-0.5, least(0.5, ret)) / 50)) over (partition by code order by date)) as e from r where ret is not null), p as (select *, max(e) over (partition by code order by date) as p from e),
    g as (select code, count(*) as n, round(max((p - e) / p * 100), 4) as dd, arg_min(e, date) as a, arg_max(e, date) as b from p group by 1)
    select code, n, case when n >= 2 then dd end as drawdown_pct, round(case when n >= 2 and dd > 1e-9 then (pow(b / a, 252.0 / greatest(n - 1, 1)) - 1) * 100 / dd end, 5) as calmar from g""",
    dates=(),
)
def risk_calmar(spark, d):
    r = returns(spark, d).withColumn("g", F.log1p(portfolio.clamp(c("ret"), -0.5, 0.5) / 50))
    e = r.select("code", "date", F.exp(F.sum("g").over(P.series.rowsBetween(-sys.maxsize, 0))).alias("equity"))
    return measures.drawdown_and_calmar(e, "code").withColumn("calmar", F.round("calmar", 5))


@register(
    "risk_tails",
    f"""with {_RET}, q as (select code, quantile_cont(ret, 0.05) as l, quantile_cont(ret, 0.95) as h, avg(ret) - 1.6448536269514726 * stddev_pop(ret) as v from r where ret is not null group by 1)
    select code, round(v, 6) as normal_var, round(abs(avg(case when ret >= h then ret end)) / abs(avg(case when ret <= l then ret end)), 5) as tail_ratio from r join q using (code) where ret is not null group by code, v""",
    dates=(),
)
def risk_tails(spark, d):
    return measures.tails(returns(spark, d), "ret", 0.05, "code").select("code", F.round("normal_var", 6).alias("normal_var"), F.round("tail_ratio", 5).alias("tail_ratio"))


#: Two curves of each supplier: of its own bars and of the orders' totals of the customer of that number.
@register(
    "diff_curves",
    f"""with {SHIPS}, o as (select o_custkey as code, cast(o_orderdate as date) as date, sum(o_totalprice) as e from orders group by 1, 2), j as (select coalesce(s.code, o.code) as code, coalesce(s.date, o.date) as date, s.close as a, o.e as b from ships s full join o on s.code = o.code and s.date = o.date),
    k as (select *, case when b is null then 'own' when a is null then 'other' else 'both' end as side from j), l as (select *, (a / lag(a) over w - 1) * 100 as ra, (b / lag(b) over w - 1) * 100 as rb from k window w as (partition by code, side order by date))
    select code, date, side, round(case when side = 'both' then ra end, 5) as own_pct, round(case when side = 'both' then rb end, 5) as other_pct, round(case when side = 'both' then ra - rb end, 5) as gap_pp from l""",
)
def diff_curves(spark, d):
    own = ships(spark, d).select("code", "date", c("close").alias("equity"))
    other = B.read(spark, d, "orders").groupBy(c("o_custkey").alias("code"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("equity"))
    return rounded(measures.curve_differences(own, other, "code"), "code", "date", "side", digits=5)


@register(
    "win_volume_anomaly",
    f"""with {SHIPS}, a as (select code, date, volume, row_number() over s as n, avg(volume) over (s rows between 19 preceding and current row) as u from ships window s as (partition by code order by date)), r as (select code, date, volume / u as r from a where n >= 20 and u <> 0)
    select code, date, round(r, 2) as ratio, case when r >= 4 then 'extreme_high' when r >= 2 then 'high' when r >= 1.5 then 'slightly_high' when r < 0.3 then 'extreme_low' when r < 0.5 then 'low' else 'normal' end as kind, case when r >= 4 then 3 when r >= 2 then 2 when r >= 1.5 then 1 when r < 0.3 then -2 when r < 0.5 then -1 else 0 end as strength from r""",
)
def win_volume_anomaly(spark, d):
    return measures.volume_anomaly(ships(spark, d))


@register(
    "filter_halted",
    f"""with {SHIPS}, b as (select code, date, case when (code + day(date)) % 9 = 0 then 0 when (code + day(date)) % 9 = 1 then null else volume end as v, case when (code + month(date)) % 11 = 0 then 'Suspended ' else '' end || s_name as name, case when (code + month(date)) % 7 = 0 then 'trading suspended' end as remark from ships join supplier on code = s_suppkey)
    select code, cast(count_if(coalesce(v > 0, true) and remark is null) as bigint) as kept, cast(count_if(v <= 0) as bigint) as no_volume, cast(count_if(coalesce(v > 0, true) and remark is not null) as bigint) as halted from b group by 1""",
    dates=(),
)
def filter_halted(spark, d):
    """The audit of what is kept, over all bars; some have their volume, name or remark replaced so that there is something to find (a capital S is no halt)."""
    b = ships(spark, d).join(B.read(spark, d, "supplier"), c("code") == c("s_suppkey"))
    b = b.withColumn("volume", F.when((c("code") + F.dayofmonth("date")) % 9 == 0, 0.0).when((c("code") + F.dayofmonth("date")) % 9 != 1, c("volume"))).withColumn("name", F.concat(F.when((c("code") + F.month("date")) % 11 == 0, "Suspended ").otherwise(""), c("s_name")))
    b = b.withColumn("remark", F.when((c("code") + F.month("date")) % 7 == 0, "trading suspended"))
    kept, audit = measures.without_halted(b, ("name", "remark"))
    return audit


@register("agg_fill_rates", f"with {_FEATS}, l as (select date, unnest(['ret1', 'range_pct', 'sector']) as name, unnest([cast(ret1 as varchar), cast(range_pct as varchar), sector]) as v from feats) select date, name, count(*) as n, count(v) as filled, round(count(v) / cast(count(*) as double), 4) as rate from l group by 1, 2")
def agg_fill_rates(spark, d):
    return measures.fill_rates(feats(spark, d), ["ret1", "range_pct", "sector"], "date")


@register(
    "scalar_limit_flags",
    f"""with {SHIPS}, b as (select code, date, lag(close) over w as p, close, case when lower(s_name) like '%1' then 4.5 when code % 3 = 0 then 19.5 else 9.5 end as l from ships join supplier on code = s_suppkey window w as (partition by code order by date)), g as (select *, (close / p - 1) * 100 as ch from b)
    select code, date, round(ch, 6) as change_pct, coalesce(ch >= l, false) as limit_up, coalesce(ch <= -l, false) as limit_down from g""",
)
def scalar_limit_flags(spark, d):
    b = ships(spark, d).join(B.read(spark, d, "supplier"), c("code") == c("s_suppkey"))
    name, code = F.when(c("s_name").endswith("1"), "*ST").otherwise("x"), F.when(c("code") % 3 == 0, "300000").otherwise("600000")
    return measures.limit_flags(b, scalars.limit_pct(code, name)).withColumn("change_pct", F.round("change_pct", 6))


@register(
    "portfolio_parity",
    f"""with {_FEATS}, i as (select code, date, sector, case when range_pct > 0 then 1 / range_pct else 0 end as i from feats), w as (select *, least(0.05, i / nullif(sum(i) over (partition by date), 0)) as w from i), h as (select *, sum(w) over (partition by date, sector) as h from w)
    select code, date, round(coalesce(case when h > 0.15 then w * 0.15 / h else w end, 0), 9) as weight from h""",
)
def portfolio_parity(spark, d):
    return measures.capped_parity(feats(spark, d), "range_pct", "sector", 0.05, 0.15).select("code", "date", F.round("weight", 9).alias("weight"))


#: All events as one market, so that most slots of the session have a price.
_MARKET = """slots as (select 0 as code, cast(ts as date) as date, time_bucket(interval '5 minutes', ts) as slot, arg_min(value, (ts, event_id)) as open, arg_max(value, (ts, event_id)) as close from events where value is not null and isfinite(value) group by 1, 2, 3),
m as (select code, date, hour(slot) * 60 + minute(slot) as t, open, close from slots)"""
TAUS = [575, 600, 660, 685, 870]


def market(spark, d):
    return B.slot_bars(B.read(spark, d, "events").withColumn("user_id", F.lit(0)))


@register(
    "session_labels",
    f"""with {_MARKET}, s as (select * from m where t between 570 and 900 and close > 0), d as (select date, arg_max(close, t) as last from s group by 1), k as (select unnest({TAUS}) as tau), e as (select tau, unnest([25, 30, 35]) as o from k), f as (select tau, case when tau <= 690 then tau - 570 else tau - 660 end + o as el from e),
    g as (select tau, case when el > 240 then null when el <= 120 then el + 570 else el + 660 end as at from f), p as (select d.date, g.tau, count(s.close) as n, avg(s.close) as p from d cross join g left join s on s.date = d.date and s.t = g.at group by 1, 2),
    r as (select 0 as code, d.date, k.tau, s.close as price, case when p.n = 3 then p.p end as e, d.last from d cross join k left join s on s.date = d.date and s.t = k.tau join p on p.date = d.date and p.tau = k.tau)
    select code, date, cast(tau as integer) as tau, price, round(e, 6) as end_price, round((last / price - 1) * 100, 5) as y_close, round((e / price - 1) * 100, 5) as y_horizon from r""",
)
def session_labels(spark, d):
    out = session.label_prices(market(spark, d), TAUS, (25, 30, 35))
    return out.select("code", "date", "tau", "price", F.round("end_price", 6).alias("end_price"), F.round("y_close", 5).alias("y_close"), F.round("y_horizon", 5).alias("y_horizon"))


@register("session_first_open", f"with {_MARKET}, s as (select date, min(t) as t, arg_min(open, t) as open from m where t >= 570 and open > 0 group by 1) select 0 as code, date, open from s where t <= 575")
def session_first_open(spark, d):
    return session.first_open(market(spark, d))
