"""Technical series, feature packs and intraday prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.panel import Panel
from tidemark.operators import packs, session, technical
from tidemark.plans.panel_queries import c, daily, rounded, ships
from tidemark.plans.registry import register
from tidemark.plans.sql import DAILY, SHIPS, SLOTS
from tidemark.sources import bars as B

P = Panel()
_EMA = "list_transform(range(1, len({x}) + 1), lambda i: list_reduce({x}[1:i], lambda e, v: e + (v - e) * 2.0 / ({n} + 1)))"


@register(
    "win_macd",
    f"""with {DAILY}, s as (select code, list(date order by date) as ds, list(close order by date) as x from bars group by 1),
    a as (select *, {_EMA.format(x='x', n=12)} as f, {_EMA.format(x='x', n=26)} as g from s), b as (select *, list_transform(list_zip(f, g), lambda p: p[1] - p[2]) as dif from a),
    e as (select *, {_EMA.format(x='dif', n=9)} as dea from b), u as (select code, unnest(ds) as date, unnest(dif) as dif, unnest(dea) as dea from e)
    select code, date, round(dif, 6) as dif, round(dea, 6) as dea, round(2 * (dif - dea), 6) as bar from u""",
)
def win_macd(spark, d):
    return rounded(technical.macd(daily(spark, d)), "code", "date")


@register(
    "win_rsi",
    f"""with {DAILY}, m as (select code, date, close - lag(close) over (partition by code order by date) as move from bars),
    s as (select code, list(date order by date) as ds, list(greatest(move, 0) order by date) as g, list(greatest(-move, 0) order by date) as l from m where move is not null group by 1 having count(*) > 14),
    f as (select code, ds[15:] as ds, list_prepend(list_sum(g[1:14]) / 14, g[15:]) as g, list_prepend(list_sum(l[1:14]) / 14, l[15:]) as l from s),
    w as (select code, unnest(ds) as date, unnest(list_transform(range(2, len(g) + 1), lambda i: list_reduce(g[1:i], lambda e, v: (e * 13 + v) / 14))) as g, unnest(list_transform(range(2, len(l) + 1), lambda i: list_reduce(l[1:i], lambda e, v: (e * 13 + v) / 14))) as l from f)
    select code, date, round(case when l = 0 then 100.0 else 100 - 100 / (1 + g / l) end, 6) as rsi from w""",
)
def win_rsi(spark, d):
    return rounded(technical.rsi(daily(spark, d)), "code", "date")


@register(
    "win_kdj",
    f"""with {DAILY}, r as (select code, date, close, min(low) over w as lo, max(high) over w as hi from bars window w as (partition by code order by date rows between 8 preceding and current row)),
    s as (select code, list(date order by date) as ds, list(case when hi > lo then (close - lo) / (hi - lo) * 100 else 50.0 end order by date) as x from r group by 1 having count(*) >= 9),
    k as (select code, ds, list_transform(range(1, len(x) + 1), lambda i: list_reduce(list_prepend(50.0, x[2:i]), lambda e, v: (e * 2 + v) / 3)) as k from s),
    q as (select code, ds, k, list_transform(range(1, len(k) + 1), lambda i: list_reduce(list_prepend(50.0, k[2:i]), lambda e, v: (e * 2 + v) / 3)) as dd from k),
    u as (select code, unnest(ds) as date, unnest(k) as k, unnest(dd) as d from q) select code, date, round(k, 6) as k, round(d, 6) as d, round(3 * k - 2 * d, 6) as j from u""",
)
def win_kdj(spark, d):
    return rounded(technical.kdj(daily(spark, d)), "code", "date")


@register(
    "win_chunk_bars",
    f"with {DAILY}, n as (select *, cast(floor((row_number() over (partition by code order by date) - 1) / 5) as bigint) as chunk from bars) select code, chunk, max(date) as date, arg_min(open, date) as open, max(high) as high, min(low) as low, arg_max(close, date) as close, sum(volume) as volume from n group by 1, 2",
)
def win_chunk_bars(spark, d):
    return technical.chunk_bars(daily(spark, d))


@register("win_obv", f"with {DAILY}, m as (select *, close - lag(close) over (partition by code order by date) as m from bars) select code, date, sum(case when m > 0 then volume when m < 0 then -volume else 0 end) over (partition by code order by date) as obv from m")
def win_obv(spark, d):
    return technical.on_balance_volume(daily(spark, d))


@register(
    "win_longest_run",
    f"""with {DAILY}, h as (select code, date, close > open as hit from bars), r as (select *, sum(case when hit then 0 else 1 end) over (partition by code order by date) as run from h),
    g as (select code, run, count_if(hit) as n from r group by 1, 2) select code, cast(max(n) as bigint) as longest, cast(arg_max(n, run) as bigint) as trailing from g group by 1""",
    dates=(),
)
def win_longest_run(spark, d):
    return technical.longest_run(daily(spark, d), c("close") > c("open"))


@register("win_drawdown", f"with {DAILY} select code, date, round((close / max(close) over (partition by code order by date) - 1) * 100, 6) as drawdown from bars")
def win_drawdown(spark, d):
    return rounded(technical.drawdown(daily(spark, d), "close"), "code", "date")


_TR = "greatest(high - low, abs(high - lag(close) over s), abs(low - lag(close) over s))"


@register(
    "win_atr",
    f"""with {DAILY}, t as (select code, date, close, case when lag(close) over s is null then high - low else {_TR} end as tr from bars window s as (partition by code order by date))
    select code, date, round(case when count(tr) over w = 5 and abs(close) > 1e-12 then avg(tr) over w / close * 100 end, 5) as atr_pct from t window w as (partition by code order by date rows between 4 preceding and current row)""",
)
def win_atr(spark, d):
    b = daily(spark, d).withColumn("true_range", technical.true_range())
    return b.select("code", "date", F.round(technical.atr_pct(5), 5).alias("atr_pct"))


@register(
    "win_rolling_sharpe",
    f"""with {SHIPS}, r as (select code, date, case when abs(lag(close) over s) > 1e-12 then close / lag(close) over s end - 1 as r from ships window s as (partition by code order by date)),
    w as (select code, date, avg(r) over w as m, stddev_samp(r) over w as s, count(r) over w as n from r window w as (partition by code order by date rows between 19 preceding and current row))
    select code, date, round(case when n = 20 and abs(s) > 1e-12 then m / s * sqrt(252.0) end, 4) as sharpe from w""",
)
def win_rolling_sharpe(spark, d):
    b = ships(spark, d).withColumn("r", P.roc(c("close"), 1))
    return b.select("code", "date", F.round(technical.rolling_sharpe(c("r"), 20), 4).alias("sharpe"))


def _pack_sql(d: int) -> str:
    """The fields from lists of the window's values, the last of which stands for today."""
    w, b = f"over (s rows between {d - 1} preceding and current row)", f"over (s rows between {d - 1} preceding and 1 preceding)"
    own = lambda x: f"list({x}) {w}"
    ending = lambda x, last: f"list_append(list({x}) {b}, {last})"
    lists = {
        "os": own("o"), "rs": own("r"), "hs": ending("high", "o"), "ls": ending("low", "o"), "vs": ending("v", "v0"), "ds": ending("dv", "v0 - v1"), "gs": ending("lv", "ln(v0 + 1)"), "qs": ending("vr", "ln(v0 / (v1 + 1e-12) + 1)"),
        "ro": f"lag(o, {d}) over s", "rv": f"lag(v, {d}) over s", "slope": f"regr_slope(o, i) {w}", "level": f"regr_intercept(o, i) {w}", "r2": f"regr_r2(o, i) {w}",
    }
    over = lambda x, y: f"({x}) / ({y} + 1e-12)"
    total = lambda x, f: f"list_sum(list_transform({x}, lambda y: {f}))"
    corr = lambda x, y: f"case when list_stddev_pop({x}) >= 1e-9 and list_stddev_pop({y}) >= 1e-9 then (list_avg(list_transform(list_zip({x}, {y}), lambda p: (p[1] - list_avg({x})) * (p[2] - list_avg({y}))))) / (list_stddev_pop({x}) * list_stddev_pop({y})) end"
    weighted = "list_transform(list_zip(rs, vs), lambda p: abs(p[1]) * p[2])"
    hi, lo = "list_max(hs)", "list_min(ls)"
    at = lambda x, v: f"(list_position({x}, {v}) - 1.0) / {d}"
    p, n = f"len(list_filter(rs, lambda y: y > 0)) / {d}.0", f"len(list_filter(rs, lambda y: y < 0)) / {d}.0"
    f = {
        "ROC": over("ro", "o"), "MA": over("list_avg(os)", "o"), "STD": over("list_stddev_pop(os)", "o"), "BETA": over("slope", "o"), "RSQR": f"case when list_var_pop(os) * {d} > 1e-12 then r2 else 0 end", "RESI": over("o - (level + slope * i)", "o"),
        "MAX": over(hi, "o"), "LOW": over(lo, "o"), "QTLU": over("list_aggregate(os, 'quantile_cont', 0.8)", "o"), "QTLD": over("list_aggregate(os, 'quantile_cont', 0.2)", "o"), "RANK": f"len(list_filter(os, lambda y: y < o)) / {d}.0",
        "RSV": over(f"o - {lo}", f"{hi} - {lo}"), "IMAX": at("hs", hi), "IMIN": at("ls", lo), "IMXD": f"{at('hs', hi)} - {at('ls', lo)}", "CORR": corr("os", "gs"), "CORD": corr("rs", "qs"), "CNTP": p, "CNTN": n, "CNTD": f"{p} - {n}",
        "SUMP": over(total("rs", "greatest(y, 0)"), total("rs", "abs(y)")), "SUMN": over(total("rs", "greatest(-y, 0)"), total("rs", "abs(y)")), "SUMD": over("list_sum(rs)", total("rs", "abs(y)")),
        "VMA": over("list_avg(vs)", "v0"), "VSTD": over("list_stddev_pop(vs)", "v0"), "WVMA": f"case when list_avg({weighted}) > 1e-12 then {over(f'list_stddev_pop({weighted})', f'list_avg({weighted})')} end",
        "VSUMP": over(total("ds", "greatest(y, 0)"), total("ds", "abs(y)")), "VSUMN": over(total("ds", "greatest(-y, 0)"), total("ds", "abs(y)")), "VSUMD": over("list_sum(ds)", total("ds", "abs(y)")),
        "VROC": over("rv", "v1"), "VRAMA": over(over("list_avg(vs)", "v1"), over("list_avg(os)", "o")),
    }
    columns = ", ".join(f"round(case when i >= 61 then {x} end, 4) + 0.0 as {k}_{d}" for k, x in f.items())
    return f"""with {SHIPS}, a as (select code, date, open as o, high, low, volume as v, open / (lag(open) over s + 1e-12) - 1 as r, volume - lag(volume) over s as dv, ln(volume + 1) as lv, ln(volume / (lag(volume) over s + 1e-12) + 1) as vr,
      row_number() over s as i, lag(volume) over s as v1, coalesce(nullif(lag(volume) over s, 0), 1.0) as v0 from ships window s as (partition by code order by date)),
    z as (select *, {', '.join(f'{x} as {k}' for k, x in lists.items())} from a window s as (partition by code order by date)) select code, date, {columns} from z"""


def _pack_open(d: int):
    def query(spark, folder):
        return packs.open_pack(ships(spark, folder), (d,), digits=4)

    return register(f"pack_open_{d}", _pack_sql(d))(query)


pack_open_5, pack_open_10, pack_open_20, pack_open_30, pack_open_60 = map(_pack_open, packs.WINDOWS)

#: Yesterday's bar (po, ph, pl, pc, pv) beside today's open, numbered within the series.
_YESTERDAY = f"""{SHIPS}, y as (select code, date, open as o, high, low, close, volume, row_number() over s as n, lag(open) over s as po, lag(high) over s as ph, lag(low) over s as pl, lag(close) over s as pc, lag(volume) over s as pv, lag(close, 2) over s as pc2, lag(close, 4) over s as pc4,
  lag(open, 2) over s as po2 from ships window s as (partition by code order by date))"""


def _fields(f: dict[str, str], least: int) -> str:
    return ", ".join(f"round(case when n > {least} then {x} end, 4) + 0.0 as {k}" for k, x in f.items())


_FLAT = "case when ph - pl > 1e-12 then ({}) / (ph - pl) else {} end"
_CANDLE = {
    "YKMID": "(pc - po) / (po + 1e-12)", "YKLEN": "(ph - pl) / (po + 1e-12)", "YKMID2": _FLAT.format("pc - po", 0), "YKUP": "(ph - greatest(po, pc)) / (po + 1e-12)", "YKUP2": _FLAT.format("ph - greatest(po, pc)", 0),
    "YKLOW": "(least(po, pc) - pl) / (po + 1e-12)", "YKLOW2": _FLAT.format("least(po, pc) - pl", 0), "YKSFT": "(2 * pc - ph - pl) / (po + 1e-12)", "YKSFT2": _FLAT.format("2 * pc - ph - pl", 0), "YBODY": "abs(pc - po) / (po + 1e-12)",
    "YUPPER_SHARE": _FLAT.format("ph - greatest(po, pc)", 0), "YLOWER_SHARE": _FLAT.format("least(po, pc) - pl", 0),
}


@register("pack_candle", f"with {_YESTERDAY} select code, date, {_fields(_CANDLE, 1)} from y")
def pack_candle(spark, d):
    return rounded(packs.candle_pack(ships(spark, d)), "code", "date", digits=4)


_GAP = {
    "GAP": "g", "GAP_ABS": "abs(g)", "CLOSE0": "pc / (o + 1e-12)", "YHIGH0": "ph / (o + 1e-12)", "YLOW0": "pl / (o + 1e-12)", "YVWAP0": "(ph + pl + pc) / 3 / (o + 1e-12)", "YOPEN0": "po / (o + 1e-12)", "OPEN_IN_YRANGE": _FLAT.format("o - pl", 0.5),
    "GAP_VS_YRANGE": "case when rp > 1e-12 then g / rp else 0 end", "GAP_ATR": "g / (coalesce(atr, 1e-12) + 1e-12)", "ABOVE_YHIGH": "case when o > ph then 1.0 else 0.0 end", "BELOW_YLOW": "case when o < pl then 1.0 else 0.0 end", "GAP_UP": "greatest(g, 0)", "GAP_DN": "greatest(-g, 0)",
    "NEAR_UPLIMIT": "(pc * 1.1 - o) / (pc + 1e-12)", "NEAR_DNLIMIT": "(o - pc * 0.9) / (pc + 1e-12)", "YCLOSE_LOC": _FLAT.format("pc - pl", 0.5), "GAP_X_YVOL": "g * vz", "GAP_X_YRANGE": "g * rp", "YOPEN_RET": "case when n >= 3 then po / (pc2 + 1e-12) - 1 else 0 end", "YRANGE_PCT": "rp", "YVOL_Z20": "vz",
    "GAP_VS_OOMA5": "g - m5", "GAP_VS_OOMA20": "g - case when n > 20 then m20 else m5 end",
}


@register(
    "pack_gap",
    f"""with {_YESTERDAY}, t as (select *, case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) / (pc + 1e-12) end as tr, case when n = 1 then 0 else o / (po + 1e-12) - 1 end as oo from y),
    u as (select *, avg(tr) over (s rows between 14 preceding and 1 preceding) as atr, case when n > 5 then avg(oo) over (s rows between 5 preceding and 1 preceding) else 0 end as m5, avg(oo) over (s rows between 20 preceding and 1 preceding) as m20, o / (pc + 1e-12) - 1 as g, (ph - pl) / (pc + 1e-12) as rp,
      case when n > 20 then (pv - avg(volume) over (s rows between 20 preceding and 1 preceding)) / (stddev_pop(volume) over (s rows between 20 preceding and 1 preceding) + 1e-12) else 0 end as vz from t window s as (partition by code order by date))
    select code, date, {_fields(_GAP, 1)} from u""",
)
def pack_gap(spark, d):
    return packs.gap_pack(ships(spark, d), digits=4)


_LAGS = {
    "OO_LAG1": "oo", "OO_LAG2": "lag(oo) over s", "OO_LAG3": "lag(oo, 2) over s", "OO_MA5": "list_avg(l5)", "OO_STD5": "list_stddev_pop(l5)", "CC_LAG1": "pc / (pc2 + 1e-12) - 1", "OC_LAG1": "pc / (po + 1e-12) - 1", "OO_SIGN_MA5": "list_avg(list_transform(l5, lambda x: sign(x)))",
    "MOM3_O": "list_sum(l5[3:])", "MOM3_C": "pc / (pc4 + 1e-12) - 1", "REV1_O": "-oo", "VOL_SHOCK": "pv / (case when n > 20 then avg(volume) over p else pv end + 1e-12)", "RANGE_SHOCK": "lag(rng) over s / (case when n > 20 then avg(rng) over p else lag(rng) over s end + 1e-12)",
    "OO_MA10": "case when n > 10 then list_avg(l10) end", "OO_STD10": "case when n > 10 then list_stddev_pop(l10) end",
}


@register(
    "pack_lags",
    f"""with {_YESTERDAY}, t as (select *, o / (po + 1e-12) - 1 as oo, (high - low) / (close + 1e-12) as rng from y), u as (select *, list(oo) over (s rows between 4 preceding and current row) as l5, list(oo) over (s rows between 9 preceding and current row) as l10 from t window s as (partition by code order by date))
    select code, date, {_fields(_LAGS, 5)} from u window s as (partition by code order by date), p as (partition by code order by date rows between 20 preceding and 1 preceding)""",
)
def pack_lags(spark, d):
    return rounded(packs.lag_pack(ships(spark, d)), "code", "date", digits=4)


_EL = "case when m between 570 and 690 then m - 570 when m between 691 and 779 then 120 when m between 780 and 900 then m - 660 end"


@register(
    "session_clock",
    f"""with e as (select event_id, cast(hour(ts) * 60 + minute(ts) as integer) as m from events), x as (select event_id, m, {_EL} as el from e),
    y as (select *, case when el + 45 between 0 and 120 then el + 615 when el + 45 between 121 and 240 then el + 705 end as later from x)
    select event_id, el as elapsed, 240 - el as remain, case when later is not null then printf('%02d:%02d', later // 60, later % 60) end as plus45, case when later is not null then el <= 120 and el + 45 > 120 end as lunch from y""",
    dates=(),
)
def session_clock(spark, d):
    m = (F.hour("ts") * 60 + F.minute("ts")).cast("int")
    e = session.elapsed(m)
    return B.read(spark, d, "events").select("event_id", e.alias("elapsed"), session.remaining(m).alias("remain"), session.hhmm(session.shifted(m, 45)).alias("plus45"), session.crosses_lunch(m, 45).alias("lunch"))


CLOCKS = [600, 660, 840, 1200]


@register(
    "session_prefix",
    f"""with {SLOTS}, m as (select *, hour(slot) * 60 + minute(slot) as mn, close / nullif(lag(close) over (partition by code, date order by slot), 0) - 1 as r1 from slots), t as (select unnest([600, 660, 840, 1200]) as tau),
    j as (select m.*, t.tau from m join t on m.mn <= t.tau),
    g as (select code, date, tau, count(*) as n, arg_min(open, slot) as f, arg_max(close, slot) as cl, max(high) as hi, min(low) as lo, arg_min(slot, (-high, slot)) as ha, arg_min(slot, (low, slot)) as la, stddev_samp(r1) as rv, sum(volume) as v, list_sum(list(volume order by slot desc)[1:3]) as v3 from j group by 1, 2, 3)
    select code, date, cast(tau as integer) as tau, n, round(case when abs(f) > 1e-12 then cl / f end - 1, 6) as ret, round(case when abs(f) > 1e-12 then (hi - lo) / f end, 6) as range, round(case when abs(hi - lo) > 1e-12 then (cl - lo) / (hi - lo) end, 6) as place,
    case when la < ha then 1 when la > ha then -1 else 0 end as path, round(case when abs(hi) > 1e-12 then cl / hi end - 1, 6) as pullback, round(case when abs(lo) > 1e-12 then cl / lo end - 1, 6) as bounce, round(rv, 6) as rv, round(v3 / v, 6) as late_share from g""",
)
def session_prefix(spark, d):
    p = session.prefix_pack(B.slot_bars(B.read(spark, d, "events")), CLOCKS)
    return rounded(p, "code", "date", "tau", "n", "path")


@register("session_price_at", f"with {SLOTS} select code, date, arg_max(close, slot) as price from slots where hour(slot) * 60 + minute(slot) <= 660 and close > 0 group by 1, 2")
def session_price_at(spark, d):
    return session.price_at(B.slot_bars(B.read(spark, d, "events")), 660)


@register(
    "session_day_class",
    f"""with {SLOTS}, g as (select code, date, count(distinct slot) as n, min(hour(slot) * 60 + minute(slot)) as a, max(hour(slot) * 60 + minute(slot)) as b from slots group by 1, 2)
    select code, date, n, case when a > 600 and b < 900 then 'both' when a > 600 then 'head' when b < 900 then 'tail' when n < 3 then 'gap' else 'ok' end as kind from g""",
)
def session_day_class(spark, d):
    return session.day_class(B.slot_bars(B.read(spark, d, "events")), 600, 900, 3)
