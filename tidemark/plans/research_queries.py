"""Labels, metrics, models, portfolios, back-tests and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tidemark.functions.panel import Panel, safe_div
from tidemark.operators import backtest, labels, metrics, models, portfolio
from tidemark.plans.merge_queries import FEATS, _FEATS, feats
from tidemark.plans.panel_queries import c, daily, rounded, ships
from tidemark.plans.registry import register
from tidemark.plans.sql import DAILY, SHIPS, SLOTS
from tidemark.sources import bars as B
from tidemark.streaming import bars as S

P = Panel()


@register("label_forward", f"with {DAILY} select code, date, round((case when abs(open) > 1e-12 then lead(open, 1) over w / open end - 1) * 100, 6) as y1, round((case when abs(open) > 1e-12 then lead(open, 5) over w / open end - 1) * 100, 6) as y5 from bars window w as (partition by code order by date)")
def label_forward(spark, d):
    return daily(spark, d).select("code", "date", F.round(labels.forward_pct(c("open"), 1), 6).alias("y1"), F.round(labels.forward_pct(c("open"), 5), 6).alias("y5"))


@register(
    "label_lags",
    f"""with {DAILY}, y as (select code, date, close - open as y from bars), l as (select code, date, list(y) over (partition by code order by date rows between unbounded preceding and 1 preceding) as h from y),
    k as (select code, date, h[greatest(1, len(h) - 4):] as v from l), m as (select *, list_avg(v) as mean from k)
    select code, date, v[-1] as lag1, round(mean, 6) as mean, round(sqrt(list_avg(list_transform(v, lambda x: (x - mean) * (x - mean)))), 6) as std,
    cast(case when len(v) > 0 then sign(v[-1]) * case when sign(v[-1]) = 0 then 0 else coalesce(list_position(list_transform(list_reverse(v), lambda x: sign(x) = sign(v[-1])), false) - 1, len(v)) end end as double) as streak from m""",
)
def label_lags(spark, d):
    y = daily(spark, d).withColumn("y", c("close") - c("open"))
    return labels.lag_features(y, "y", 5).select("code", "date", "lag1", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), (c("streak").cast("double") + 0.0).alias("streak"))


@register("label_holdout", f"with {DAILY}, r as (select date, row_number() over (order by date desc) as b from (select distinct date from bars)) select code, date, case when b <= 6 then 'test' when b <= 9 then 'embargo' else 'train' end as part from bars join r using (date)")
def label_holdout(spark, d):
    return labels.holdout(daily(spark, d), 6, 3).select("code", "date", "part")


@register(
    "label_walk_forward",
    f"with {DAILY}, r as (select date, row_number() over (order by date desc) - 1 as b from (select distinct date from bars)), f as (select cast(unnest(range(3)) as integer) as fold) select fold, case when b between fold * 4 and fold * 4 + 3 then 'test' else 'train' end as part, date from r, f where b between fold * 4 and fold * 4 + 3 or b >= fold * 4 + 6",
)
def label_walk_forward(spark, d):
    return labels.walk_forward(daily(spark, d), folds=3, test=4, embargo=2)


_XY = f"""{_FEATS}, xy as (select code, date, sector, range_pct as score, volume, lead(ret1) over (partition by code order by date) as y from feats)"""


def xy(spark, d):
    f = feats(spark, d)
    return f.select("code", "date", "sector", c("range_pct").alias("score"), "volume", P.ref(c("ret1"), -1).alias("y"))


_RANKS = "ok as (select * from xy where score is not null and y is not null), rk as (select date, score, y, rank() over (partition by date order by score) + (count(*) over (partition by date, score) - 1) / 2.0 as rx, rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2.0 as ry from ok)"


@register("metric_daily_ic", f"with {_XY}, {_RANKS} select date, count(*) as n, round(corr(score, y), 6) as ic, round(corr(rx, ry), 6) as rank_ic from rk group by date having count(*) >= 3")
def metric_daily_ic(spark, d):
    return rounded(metrics.rank_ic(xy(spark, d), "score", "y", least=3), "date", "n")


@register(
    "metric_auc",
    f"""with {_XY}, ok as (select sector, score, case when y > 0 then 1.0 else 0.0 end as l from xy where score is not null and y is not null and sector is not null), k as (select *, rank() over (partition by sector order by score) + (count(*) over (partition by sector, score) - 1) / 2.0 as r from ok)
    select sector, round((sum(r * l) - sum(l) * (sum(l) + 1) / 2) / (sum(l) * (count(*) - sum(l))), 6) as auc from k group by 1""",
    dates=(),
)
def metric_auc(spark, d):
    rows = xy(spark, d).where("y is not null and sector is not null").withColumn("label", (c("y") > 0).cast("double"))
    return metrics.auc(rows, "score", "label", "sector").select("sector", F.round("auc", 6).alias("auc"))


@register(
    "metric_calibration",
    """with r as (select l_returnflag as grp, least(0.99, greatest(0.01, l_discount * 8)) as p, case when l_linestatus = 'O' then 1.0 else 0.0 end as y from lineitem)
    select grp, round(avg((p - y) * (p - y)), 6) as brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as log_loss, round(avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as accuracy,
    round(sum(case when p >= 0.5 and y = 1 then 1.0 else 0 end) / nullif(sum(case when p >= 0.5 then 1.0 else 0 end), 0), 6) as precision, round(sum(case when p >= 0.5 and y = 1 then 1.0 else 0 end) / nullif(sum(y), 0), 6) as recall from r group by 1""",
    dates=(),
)
def metric_calibration(spark, d):
    r = B.read(spark, d, "lineitem").select(c("l_returnflag").alias("grp"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), c("l_discount") * 8)).alias("p"), F.when(c("l_linestatus") == "O", 1.0).otherwise(0.0).alias("y"))
    return rounded(r.groupBy("grp").agg(*(v.alias(k) for k, v in metrics.calibration(c("p"), c("y")).items())), "grp")


@register(
    "metric_ndcg",
    f"""with {_XY}, ok as (select * from xy where score is not null and y is not null), p as (select date, row_number() over (partition by date order by y, code desc) - 1 as g, row_number() over (partition by date order by score desc, code) as a, row_number() over (partition by date order by y desc, code) as b from ok)
    select date, round(sum(case when a <= 10 then g / log2(a + 1.0) end) / nullif(sum(case when b <= 10 then g / log2(b + 1.0) end), 0), 6) as ndcg from p group by 1""",
)
def metric_ndcg(spark, d):
    return metrics.ndcg(xy(spark, d), "score", "y", 10).select("date", F.round("ndcg", 6).alias("ndcg"))


@register(
    "metric_quantile_spread",
    f"""with {_XY}, ok as (select * from xy where score is not null and y is not null), p as (select date, y, ceil(count(*) over (partition by date) * 0.2) as k, row_number() over (partition by date order by score desc, code) as a, row_number() over (partition by date order by score, code desc) as b from ok)
    select date, round(avg(case when a <= k then y end), 6) as top, round(avg(case when b <= k then y end), 6) as bottom, round(avg(case when a <= k then y end) - avg(case when b <= k then y end), 6) as spread from p group by 1""",
)
def metric_quantile_spread(spark, d):
    return rounded(metrics.quantile_spread(xy(spark, d), "score", "y", 0.2), "date")


@register(
    "metric_top_overlap",
    f"""with {_XY}, ok as (select * from xy where score is not null and volume is not null), p as (select date, row_number() over (partition by date order by score desc, code) as a, row_number() over (partition by date order by volume desc, code) as b from ok)
    select date, round(count_if(a <= 20 and b <= 20) / cast(count_if(a <= 20) as double), 6) as overlap from p group by 1""",
)
def metric_top_overlap(spark, d):
    return metrics.top_overlap(xy(spark, d), "score", "volume", 20).select("date", F.round("overlap", 6).alias("overlap"))


@register(
    "model_one_factor",
    f"with {_XY}, ok as (select * from xy where score is not null and y is not null), b as (select regr_slope(y, score) as slope, regr_intercept(y, score) as level, avg(score) as mu, stddev_pop(score) as sd, avg(y) as my from ok) select code, date, round(my + slope * (score - mu), 6) as pred from xy, b where score is not null",
)
def model_one_factor(spark, d):
    """Least squares on one factor (ridge without a penalty), scored for every row that has it."""
    rows = xy(spark, d)
    both = rows.where("score is not null and y is not null")
    return models.predicted(rows, models.ridge(both, ["score"], "y", 0.0)).where("pred is not null").select("code", "date", "pred")


def _det(a: list[list[str]]) -> str:
    return f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"


_M = [["d", "m12", "m13"], ["m12", "d", "m23"], ["m13", "m23", "d"]]
_BETA = [_det([[f"c{i + 1}" if j == k else _M[i][j] for j in range(3)] for i in range(3)]) + f" / {_det(_M)}" for k in range(3)]

#: Three standard scores with a penalty of one: the normal equations by Cramer's rule.
_RIDGE = f"""with {_FEATS}, t as (select ret1 as x1, range_pct as x2, volume as x3, lead(ret1) over (partition by code order by date) as y from feats), u as (select * from t where y is not null), a as (select count(*) as n, avg(x1) as u1, avg(x2) as u2, avg(x3) as u3, avg(y) as uy from u),
v as (select coalesce(x1 - u1, 0) as z1, coalesce(x2 - u2, 0) as z2, coalesce(x3 - u3, 0) as z3, y - uy as w from u, a), g as (select sqrt(sum(z1 * z1) / count(*)) as s1, sqrt(sum(z2 * z2) / count(*)) as s2, sqrt(sum(z3 * z3) / count(*)) as s3, sum(z1 * z2) as g12, sum(z1 * z3) as g13, sum(z2 * z3) as g23, sum(z1 * w) as b1, sum(z2 * w) as b2, sum(z3 * w) as b3 from v),
e as (select a.*, s1, s2, s3, n + 1 as d, g12 / (s1 * s2) as m12, g13 / (s1 * s3) as m13, g23 / (s2 * s3) as m23, b1 / s1 as c1, b2 / s2 as c2, b3 / s3 as c3 from a, g),
r as (select unnest(['ret1', 'range_pct', 'volume', '(intercept)']) as feature, unnest([{', '.join(_BETA)}, uy]) as beta, unnest([u1, u2, u3, 0]) as mu, unnest([s1, s2, s3, 0]) as sigma from e)
select feature, round(beta, 6) + 0.0 as beta, round(mu, 6) + 0.0 as mu, round(sigma, 6) + 0.0 as sigma from r"""


@register("model_ridge", _RIDGE, dates=())
def model_ridge(spark, d):
    f = feats(spark, d).withColumn("y", F.lead("ret1").over(P.series))
    return rounded(models.ridge(f, FEATS, "y", 1.0), "feature")


@register("model_logistic")
def model_logistic(spark, d):
    f = feats(spark, d).withColumn("next", F.lead("ret1").over(P.series)).withColumn("up", F.when(c("next").isNotNull(), (c("next") > 0).cast("double")))
    return rounded(models.logistic(f, FEATS, "up"), "feature", digits=4)


@register(
    "cost_trades",
    """with t as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice as amount, l_returnflag = 'R' as sell, l_discount as vol, l_quantity * 1e5 as day_amount, l_extendedprice / l_quantity as price from lineitem)
    select l_orderkey, l_linenumber, l_partkey, round(greatest(1, least(30, 2 + vol * 10)), 6) as slippage, round(least(50, 0.1 * sqrt(case when abs(day_amount) > 1e-12 then amount / day_amount else 0 end) * 100), 6) as impact,
    round(greatest(amount * 0.00025, 5) + case when sell then amount * 0.0005 else 0 end, 2) as fees, cast(floor(amount / price / 100) * 100 as bigint) as shares from t where price > 0""",
    dates=(),
)
def cost_trades(spark, d):
    t = B.read(spark, d, "lineitem").withColumn("price", c("l_extendedprice") / c("l_quantity")).where("price > 0")
    return t.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(portfolio.slippage_bps(c("l_discount")), 6).alias("slippage"), F.round(portfolio.impact_bps(c("l_extendedprice"), c("l_quantity") * 1e5), 6).alias("impact"),
        portfolio.fees(c("l_extendedprice"), c("l_returnflag") == "R").alias("fees"), portfolio.lots(c("l_extendedprice"), c("price")).alias("shares"),
    )


@register("risk_exposure", "with h as (select n_name as sector, sum(s_acctbal) as value from supplier join nation on s_nationkey = n_nationkey group by 1) select sector, round(value, 2) as value, round(value / (select sum(value) from h) * 100, 6) as weight_pct from h", dates=())
def risk_exposure(spark, d):
    h = B.read(spark, d, "supplier").join(B.read(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")).select(c("n_name").alias("sector"), c("s_acctbal").alias("value"))
    return portfolio.exposure(h, "sector").select("sector", F.round("value", 2).alias("value"), F.round("weight_pct", 6).alias("weight_pct"))


_RET = f"{SHIPS}, r as (select code, date, case when abs(lag(close) over w) > 1e-12 then close / lag(close) over w end - 1 as ret from ships window w as (partition by code order by date))"


def returns(spark, d):
    return ships(spark, d).select("code", "date", P.roc(c("close"), 1).alias("ret")).where("ret is not null")


@register("risk_tail", f"with {_RET}, q as (select code, quantile_cont(ret, 0.05) as v from r where ret is not null group by 1) select code, round(v, 6) as var, round(avg(ret), 6) as cvar from r join q using (code) where ret <= v group by code, v", dates=())
def risk_tail(spark, d):
    return rounded(portfolio.tail_risk(returns(spark, d), "ret", 0.05, "code"), "code")


@register(
    "risk_kupiec",
    f"""with {_RET}, g as (select code, count(ret) as n, count_if(ret < -0.6) as x from r where ret is not null group by 1), p as (select *, greatest(1e-12, least(1 - 1e-12, x / n)) as p from g)
    select code, n, cast(x as bigint) as breaches, round(greatest(0, -2 * ((n - x) * ln(0.95) + x * ln(0.05) - (n - x) * ln(1 - p) - x * ln(p))), 5) as lr from p""",
    dates=(),
)
def risk_kupiec(spark, d):
    return portfolio.kupiec(returns(spark, d), "ret", F.lit(-0.6), 0.05, "code").withColumn("lr", F.round("lr", 5))


_INDEX = f"{_RET}, i as (select date, avg(greatest(-0.5, least(0.5, ret))) as ret from r where ret is not null group by 1)"


def index_returns(spark, d):
    return returns(spark, d).groupBy("date").agg(F.avg(portfolio.clamp(c("ret"), -0.5, 0.5)).alias("ret"))


@register(
    "risk_scenarios",
    f"""with {_INDEX}, s as (select * from (values ('early', date '1995-01-01', date '1995-03-31'), ('late', date '2000-06-01', date '2000-08-31'), ('both', date '1995-03-01', date '2000-06-30')) t(scenario, a, b))
    select scenario, count(*) as days, round(vol, 6) as vol, round(worst_pct, 6) as worst_pct, round(l, 5) as log_total from (select scenario, stddev_pop(ret) as vol, min(ret) * 100 as worst_pct, sum(ln(1 + ret)) as l, list(ret) as x from i join s on date between a and b group by 1), unnest(x) group by all""",
    dates=(),
)
def risk_scenarios(spark, d):
    ranges = spark.createDataFrame([("early", "1995-01-01", "1995-03-31"), ("late", "2000-06-01", "2000-08-31"), ("both", "1995-03-01", "2000-06-30")], "scenario string, first string, last string")
    ranges = ranges.select("scenario", c("first").cast("date").alias("first"), c("last").cast("date").alias("last"))
    found = portfolio.scenarios(index_returns(spark, d), ranges)
    return found.select("scenario", "days", F.round("vol", 6).alias("vol"), F.round("worst_pct", 6).alias("worst_pct"), F.round("log_total", 5).alias("log_total"))


_TRACKED = "case when stddev_pop(a) > 1e-9 and stddev_pop(b) > 1e-9 then corr(a, b) end as k, stddev_pop(a - b) as sd, avg(a - b) as mean"


def _tracked(t, *keys):
    return t.select(*keys, "n", F.round("corr", 6).alias("corr"), F.round("tracking_error", 5).alias("tracking_error"), F.round("ir", 6).alias("ir"))


@register(
    "risk_tracking",
    f"""with {_INDEX}, j as (select s_nationkey, date, avg(greatest(-0.5, least(0.5, r.ret))) as a, any_value(i.ret) as b from r join i using (date) join supplier on code = s_suppkey where r.ret is not null group by 1, 2), g as (select s_nationkey as nation, count(*) as n, {_TRACKED} from j group by 1)
    select nation, n, round(k, 6) as corr, round(sd * sqrt(252.0), 5) as tracking_error, round(case when sd > 1e-12 then mean / sd end, 6) as ir from g""",
    dates=(),
)
def risk_tracking(spark, d):
    """The mean return of each nation's suppliers against that of all."""
    place = B.read(spark, d, "supplier").select(c("s_suppkey").alias("code"), c("s_nationkey").alias("nation"))
    own = returns(spark, d).join(place, "code").groupBy("nation", "date").agg(F.avg(portfolio.clamp(c("ret"), -0.5, 0.5)).alias("a"))
    return _tracked(portfolio.tracking(own.join(index_returns(spark, d).select("date", c("ret").alias("b")), "date"), "a", "b", "nation"), "nation")


@register(
    "risk_tracking_codes",
    f"""with {_INDEX}, j as (select r.code, r.ret as a, i.ret as b from r join i using (date) where r.ret is not null), g as (select code, count(*) as n, case when stddev_pop(a) > 1e-9 and stddev_pop(b) > 1e-9 then corr(a, b) end as k, stddev_pop(a - b) as sd, avg(a - b) as mean from j group by 1)
    select code, n, round(k, 6) as corr, round(sd * sqrt(252.0), 5) as tracking_error, round(case when sd > 1e-12 then mean / sd end, 6) as ir from g""",
    dates=(),
)
def risk_tracking_codes(spark, d):
    both = returns(spark, d).select("code", "date", c("ret").alias("a")).join(index_returns(spark, d).select("date", c("ret").alias("b")), "date")
    return _tracked(portfolio.tracking(both, "a", "b", "code"), "code")


@register(
    "risk_brinson",
    """with g as (select c_mktsegment as sector, sum(case when o_orderstatus = 'F' then o_totalprice else 0 end) as v, sum(o_totalprice) as u, avg(case when o_orderstatus = 'F' then o_totalprice end) / 1e6 as r, avg(o_totalprice) / 1e6 as q from orders join customer on o_custkey = c_custkey group by 1),
    w as (select *, v / sum(v) over () as w, u / sum(u) over () as b from g), t as (select *, sum(b * q) over () as total from w)
    select sector, round((w - b) * (q - total), 9) as allocation, round(b * (r - q), 9) as selection, round((w - b) * (r - q), 9) as interaction from t""",
    dates=(),
)
def risk_brinson(spark, d):
    from pyspark.sql import Window

    o = B.read(spark, d, "orders").join(B.read(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    own = F.when(c("o_orderstatus") == "F", c("o_totalprice"))
    g = o.groupBy(c("c_mktsegment").alias("sector")).agg(F.sum(F.coalesce(own, F.lit(0.0))).alias("v"), F.sum("o_totalprice").alias("u"), (F.avg(own) / 1e6).alias("r"), (F.avg("o_totalprice") / 1e6).alias("q"))
    every = Window.partitionBy()
    w = g.withColumns({"w": c("v") / F.sum("v").over(every), "b": c("u") / F.sum("u").over(every)})
    return rounded(portfolio.brinson(w, "sector", "w", "b", "r", "q"), "sector", digits=9)


@register(
    "portfolio_turnover",
    f"""with {DAILY}, w as (select code, date, volume / sum(volume) over (partition by date) as w from bars), d as (select date, lag(date) over (order by date) as before from (select distinct date from bars)), k as (select code, date from w union select w.code, d.date from w join d on w.date = d.before),
    j as (select k.code, k.date, coalesce(a.w, 0) - coalesce(b.w, 0) as delta from k join d using (date) left join w a on a.code = k.code and a.date = k.date left join w b on b.code = k.code and b.date = d.before where d.before is not null)
    select date, count(*) as n, round(sum(abs(delta)) / 2, 9) as turnover, round(sum(greatest(delta, 0)), 9) as bought from j group by 1""",
)
def portfolio_turnover(spark, d):
    b = daily(spark, d)
    weights = b.select("code", "date", (c("volume") / F.sum("volume").over(P.day)).alias("weight"))
    return rounded(portfolio.turnover_by_date(weights), "date", "n", digits=9)


def _capped_sql(cap: float, rounds: int = 8) -> str:
    steps = [f"w0 as (select code, date, volume / sum(volume) over (partition by date) as w from bars)"]
    for i in range(rounds):
        free, over = f"case when w < {cap} then w else 0 end", f"greatest(w - {cap}, 0)"
        steps.append(f"w{i + 1} as (select code, date, least({cap}, w + sum({over}) over d * coalesce({free} / nullif(sum({free}) over d, 0), 0)) as w from w{i} window d as (partition by date))")
    return f"with {DAILY}, {', '.join(steps)} select code, date, round(w, 9) as weight from w{rounds}"


@register("portfolio_capped_weights", _capped_sql(0.012))
def portfolio_capped_weights(spark, d):
    return portfolio.capped_weights(daily(spark, d), "volume", 0.012).select("code", "date", F.round("weight", 9).alias("weight"))


@register(
    "bt_overlapping",
    f"""with {DAILY}, t as (select code, date, close / nullif(open, 0) as score, close, lead(open, 1) over w as e, lead(open, 4) over w as x from bars window w as (partition by code order by date))
    select code, date, e as entry, x as exit, round((case when abs(e) > 1e-12 then x / e end - 1) * 100 - 0.2, 6) as ret_pct from t where score >= 1 and e is not null and x is not null and not (e / close - 1 >= 0.095)""",
)
def bt_overlapping(spark, d):
    b = daily(spark, d).withColumn("score", safe_div(c("close"), c("open")))
    return backtest.overlapping_trades(b, "score", 1.0, 3, 0.2).withColumn("ret_pct", F.round("ret_pct", 6))


@register("bt_walk")
def bt_walk(spark, d):
    b = daily(spark, d).withColumn("score", safe_div(c("close"), c("open")))
    return backtest.walk(b, "score", 1.0, 3, 0.2).withColumn("ret_pct", F.round("ret_pct", 6))


@register(
    "bt_summary",
    f"""with {DAILY}, t as (select code, date, close / nullif(open, 0) as score, close, lead(open, 1) over w as e, lead(open, 4) over w as x from bars window w as (partition by code order by date)),
    r as (select code, greatest(-90, least(200, (case when abs(e) > 1e-12 then x / e end - 1) * 100 - 0.2)) as ret_pct from t where score >= 1 and e is not null and x is not null and not (e / close - 1 >= 0.095))
    select code, count(*) as n, round(avg(case when ret_pct > 0 then 1.0 else 0.0 end) * 100, 6) as win_pct, round(avg(ret_pct), 6) as mean_pct from r group by 1""",
    dates=(),
)
def bt_summary(spark, d):
    b = daily(spark, d).withColumn("score", safe_div(c("close"), c("open")))
    t = backtest.overlapping_trades(b, "score", 1.0, 3, 0.2).withColumn("ret_pct", portfolio.clamp(c("ret_pct"), -90, 200))
    return rounded(backtest.trade_summary(t, "code").drop("total_pct"), "code", "n")


@register(
    "bt_top_k",
    f"""with {SHIPS}, m as (select code, date_trunc('month', date) as date, arg_min(open, date) as open, sum(volume) as volume from ships group by 1, 2), t as (select code, date, volume as score, (case when abs(lead(open, 1) over w) > 1e-12 then lead(open, 3) over w / lead(open, 1) over w end - 1) * 100 as a from m window w as (partition by code order by date)),
    p as (select *, row_number() over (partition by date order by score desc, code) as k from t where a is not null and score is not null), g as (select date, count(*) as n, avg(a) as r from p where k <= 10 group by 1) select cast(date as date) as date, n, round(r, 5) as ret_pct, round(sum(ln(1 + r / 100)) over (order by date), 5) as log_curve from g""",
)
def bt_top_k(spark, d):
    m = ships(spark, d).groupBy("code", F.trunc("date", "month").alias("month")).agg(F.min_by("open", "date").alias("open"), F.sum("volume").alias("score")).withColumnRenamed("month", "date")
    return backtest.top_k_curve(m, "score", 10, 2).select("date", "n", F.round("ret_pct", 5).alias("ret_pct"), F.round(F.log("curve"), 5).alias("log_curve"))


_LOTS = "{} as (select l_partkey as code, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 as id, min(cast(l_shipdate as date)) as t, cast(sum(l_quantity) as bigint) as quantity from lineitem where l_returnflag {} group by 1, 2)"


@register(
    "bt_first_in_first_out",
    f"""with {_LOTS.format('b0', "in ('N', 'A')")}, {_LOTS.format('s0', "= 'R'")},
    b as (select code, id, sum(quantity) over w as e, sum(quantity) over w - quantity as a from b0 window w as (partition by code order by t, id)),
    k as (select s0.code, s0.id, s0.t, s0.quantity as q, coalesce((select sum(quantity) from b0 where b0.code = s0.code and b0.t < s0.t), 0) as have from s0),
    l as (select code, list(id order by t, id) as ids, list({{'e': cast(q as bigint), 'have': cast(have as bigint)}} order by t, id) as x from k group by 1),
    m as (select code, unnest(ids) as id, unnest(list_transform(range(1, len(x) + 1), lambda i: list_reduce(list_prepend({{'e': cast(0 as bigint), 'have': cast(0 as bigint)}}, x[1:i]), lambda u, v: {{'e': least(u.e + v.e, v.have), 'have': cast(0 as bigint)}}).e)) as e, unnest(range(1, len(x) + 1)) as place from l),
    s as (select code, id, e, coalesce(lag(e) over (partition by code order by place), 0) as a from m)
    select b.code, b.id as buy_id, s.id as sell_id, cast(least(b.e, s.e) - greatest(b.a, s.a) as bigint) as quantity from b join s on b.code = s.code and b.a < s.e and s.a < b.e where s.a < s.e""",
    dates=(),
)
def bt_first_in_first_out(spark, d):
    l = B.read(spark, d, "lineitem").select(c("l_partkey").alias("code"), (c("l_orderkey") * 1000 + c("l_linenumber") * 100 + c("l_suppkey") % 100).alias("id"), F.to_date("l_shipdate").alias("at"), c("l_quantity").cast("long").alias("quantity"), "l_returnflag")
    of = lambda flags: l.where(c("l_returnflag").isin(*flags)).groupBy("code", "id").agg(F.min("at").alias("at"), F.sum("quantity").alias("quantity"))
    return backtest.first_in_first_out(of(["N", "A"]), of(["R"]))


# Streams over the events, run until all that is there has been read.

def _streamed(spark, d, make, mode="append"):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp()
    base = base.rstrip("/")
    name = f"{base}/stream-{uuid.uuid4().hex}"
    S.run_once(make(S.events_stream(spark, f"{d}/events.parque[t]")), f"{name}/out", f"{name}/state", mode)
    return spark.read.parquet(f"{name}/out")


@register(
    "stream_session_bars",
    """with g as (select user_id as code, ts, case when ts - lag(ts) over w < interval 60 minutes then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), s as (select code, ts, sum(fresh) over (partition by code order by ts rows unbounded preceding) as k from g),
    b as (select code, min(ts) as start, max(ts) + interval 60 minutes as "end", count(*) as n from s group by code, k) select code, start, "end", n from b where "end" <= (select date_trunc('milliseconds', max(ts)) - interval 10 minutes from events)""",
    dates=("start", "end"),
)
def stream_session_bars(spark, d):
    """Sessions that had ended by the stream's last watermark."""
    return _streamed(spark, d, S.session_bars)


@register("stream_windowed_bars", f"with {SLOTS} select code, slot as start, open, high, low, close, volume from slots where slot + interval 5 minutes <= (select date_trunc('milliseconds', max(ts)) - interval 10 minutes from events)", dates=("start",))
def stream_windowed_bars(spark, d):
    """Five-minute bars whose windows had ended by the stream's last watermark."""
    return _streamed(spark, d, S.windowed_bars)


@register("stream_high_water", "with t as (select user_id as code, ts, min(event_id) as first, count(*) as n from events group by 1, 2) select code, arg_max(first, ts) as last_id, count(*) as n_new, cast(sum(n) - count(*) as bigint) as n_late from t group by 1", dates=())
def stream_high_water(spark, d):
    return _streamed(spark, d, S.high_water)
