"""Features of a day's prefix up to a clock."""

from __future__ import annotations

from tidemark.operators import session
from tidemark.plans.measure_queries import market
from tidemark.plans.panel_queries import rounded
from tidemark.plans.registry import register

CLOCKS = [575, 600, 660, 685, 780, 870]
TRAILS = (30, 45, 60, 75, 90)


def in_session(spark, d):
    """All events as one market, within the session, so that most slots have a price."""
    from pyspark.sql import functions as F

    return market(spark, d).where((F.hour("slot") * 60 + F.minute("slot")).between(570, 900))


_DAY = """slots as (select 0 as code, cast(ts as date) as date, time_bucket(interval '5 minutes', ts) as slot, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, cast(count(*) as double) as volume from events where value is not null and isfinite(value) group by 1, 2, 3),
m as (select *, hour(slot) * 60 + minute(slot) as t from slots where hour(slot) * 60 + minute(slot) between 570 and 900 and close > 0)"""
_HI, _LO = "list_max(h)", "list_min(l)"
_RATIO = "case when n >= 3 and list_avg(v) > 1e-12 then list_avg(v[-3:]) / list_avg(v) end"
_FIELDS = {
    "ret_open_to_tau": "(px / o - 1) * 100", "ret_prev_to_tau": "(px / before - 1) * 100", "range_pct": "(hi - lo) / o * 100", "up_extent": "(hi - o) / o * 100", "down_extent": "(o - lo) / o * 100", "loc_hl": "case when hi - lo > 1e-12 then (px - lo) / (hi - lo) else 0.5 end", "path_sign": "case when tl < th then 1.0 else -1.0 end",
    "pullback_from_high": "(hi - px) / hi * 100", "bounce_from_low": "(px - lo) / lo * 100", "ret_last_15m": "r15", "realized_vol": "case when n >= 3 then list_stddev_samp(rs) end", "vol_last3_vs_avg": "vr", "t_hi_frac": "fh", "t_lo_frac": "fl", "room_to_high": "(hi - px) / px * 100", "room_to_low": "(px - lo) / px * 100",
    "t_hi_minus_lo": "fh - fl", "mom_accel_5_15": "r5 - r15", "mom_accel_5_30": "r5 - r30", "vol_down_up": "case when uv > 1e-12 then least(dv / uv, 10) when dv > 1e-12 then 10.0 end", "vol_up_share": "case when uv + dv > 1e-12 then uv / (uv + dv) when n >= 2 then 0.5 end",
    "range_efficiency": "case when (hi - lo) / o * 100 > 1e-6 then least(1, abs((px / o - 1) * 100) / ((hi - lo) / o * 100)) else 0 end", "vp_confirm": "case when vr is not null then greatest(-30, least(30, (px / o - 1) * 100 * (vr - 1))) end", "pullback_x_vol": "case when vr is not null then (hi - px) / hi * 100 * greatest(0, vr) end",
}


@register(
    "session_wide_prefix",
    f"""with {_DAY}, k as (select unnest({CLOCKS}) as tau), d as (select date, arg_max(close, t) as last from m group by 1), b as (select date, lag(last) over (order by date) as before from d),
    g as (select date, tau, count(*) as n, list(t order by t) as t, list(open order by t) as op, list(high order by t) as h, list(low order by t) as l, list(close order by t) as c, list(volume order by t) as v from m join k on m.t <= k.tau group by 1, 2),
    e as (select *, c[-1] as px, op[1] as o, {_HI} as hi, {_LO} as lo, t[list_position(h, {_HI})] as th, t[list_position(l, {_LO})] as tl, case when n >= 2 then (c[-1] / c[-2] - 1) * 100 end as r5, case when n >= 2 then (c[-1] / c[-least(3, n)] - 1) * 100 end as r15, case when n >= 2 then (c[-1] / c[-least(6, n)] - 1) * 100 end as r30, {_RATIO} as vr,
      case when n >= 2 then list_transform(range(2, n + 1), lambda i: (c[i] / c[i - 1] - 1) * 100) end as rs, case when n >= 2 then list_sum(list_transform(range(2, n + 1), lambda i: case when c[i] > c[i - 1] then v[i] else 0 end)) else 0 end as uv, case when n >= 2 then list_sum(list_transform(range(2, n + 1), lambda i: case when c[i] < c[i - 1] then v[i] else 0 end)) else 0 end as dv from g),
    f as (select *, case when t[-1] > 570 then greatest(0, least(1, (th - 570) / (t[-1] - 570))) end as fh, case when t[-1] > 570 then greatest(0, least(1, (tl - 570) / (t[-1] - 570))) end as fl from e join b using (date))
    select 0 as code, date, cast(tau as integer) as tau, n, {', '.join(f'round({v}, 5) + 0.0 as {k}' for k, v in _FIELDS.items())} from f""",
)
def session_wide_prefix(spark, d):
    return rounded(session.wide_prefix(in_session(spark, d), CLOCKS), "code", "date", "tau", "n", digits=5)


def _trail(k: int) -> str:
    gone = f"(el - {k})"
    at = f"case when {gone} < 0 then null when {gone} <= 120 then {gone} + 570 else {gone} + 660 end"
    return f"""case when el + {k} <= 240 then case when el <= 120 and el + {k} > 120 then 1.0 else 0.0 end end as crosses_lunch_{k},
    round((px / coalesce(c[nullif(list_position(t, {at}), 0)], case when {at} = 570 then op[1] end) - 1) * 100, 5) + 0.0 as ret_last_{k}, round(list_avg(list_transform(list_filter(list_zip(t, v), lambda z: z[1] > {at}), lambda z: z[2])) / list_avg(v), 5) as vol_last_{k}"""


@register(
    "session_trailing",
    f"""with {_DAY}, k as (select unnest({CLOCKS}) as tau), g as (select date, tau, count(*) as n, list(t order by t) as t, list(open order by t) as op, list(close order by t) as c, list(volume order by t) as v, sum((high + low + close) / 3 * volume) / sum(volume) as vw from m join k on m.t <= k.tau group by 1, 2),
    e as (select *, c[-1] as px, case when tau <= 690 then tau - 570 when tau < 780 then 120 else tau - 660 end as el from g)
    select 0 as code, date, cast(tau as integer) as tau, cast(el as double) as session_elapsed, cast(240 - el as double) as session_remain, round(case when n >= 2 then (px / c[-2] - 1) * 100 end, 5) + 0.0 as ret_last_5m, round((px - vw) / px * 100, 5) + 0.0 as session_vwap_dev, {', '.join(map(_trail, TRAILS))} from e""",
)
def session_trailing(spark, d):
    return rounded(session.trailing_pack(in_session(spark, d), CLOCKS, TRAILS), "code", "date", "tau", digits=5)
