"""Gram matrices of a panel and what is made of them, over all suppliers' shipping days."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.panel import Panel
from tidemark.operators import algebra, covariance
from tidemark.plans.market_queries import _grouped_sql, grouped
from tidemark.plans.panel_queries import c, rounded, ships
from tidemark.plans.registry import register
from tidemark.plans.research_queries import _RET, returns
from tidemark.plans.sql import SHIPS
from tidemark.sources import bars as B

P = Panel()
FEATURES = ["r1", "r5", "r20", "spread", "size"]
#: Returns over 1, 5 and 20 rows, the span and size of a bar, columns that are flat or mostly missing, and the next return as label.
_PANEL = f"""{SHIPS}, pan as (select code, date, close / lag(close) over s - 1 as r1, close / lag(close, 5) over s - 1 as r5, close / lag(close, 20) over s - 1 as r20, (high - low) / close as spread, ln(volume) as size,
  1.0 as flat, case when row_number() over s = 1 and code % 4 = 0 then close end as rare, close as SUMP5, lead(close) over s / close - 1 as y from ships window s as (partition by code order by date))"""


def panel(spark, d):
    s = P.series
    ratio = lambda k: c("close") / F.lag("close", k).over(s) - 1
    return ships(spark, d).select(
        "code", "date", ratio(1).alias("r1"), ratio(5).alias("r5"), ratio(20).alias("r20"), ((c("high") - c("low")) / c("close")).alias("spread"), F.log("volume").alias("size"),
        F.lit(1.0).alias("flat"), F.when((F.row_number().over(s) == 1) & (c("code") % 4 == 0), c("close")).alias("rare"), c("close").alias("SUMP5"), (F.lead("close").over(s) / c("close") - 1).alias("y"),
    )


@register(
    "panel_orthogonal",
    f"""with {_PANEL}, ok as (select * from pan where r1 is not null and r5 is not null and r20 is not null), m as (select avg(r1) as m1, avg(r5) as m5, avg(r20) as m20 from ok), a as (select code, date, r1 - m1 as a, r5 - m5 as b, r20 - m20 as c from pan, m),
    g1 as (select sum(a * b) / sum(a * a) as ab, sum(a * c) / sum(a * a) as ac from a where c is not null), b as (select code, date, a, b - ab * a as b, c - ac * a as c from a, g1), g2 as (select sum(b * c) / sum(b * b) as bc from b where c is not null), d as (select code, date, a, b, c - bc * b as c from b, g2),
    n as (select sqrt(sum(a * a)) as na, sqrt(sum(b * b)) as nb, sqrt(sum(c * c)) as nc from d where c is not null)
    select code, date, round(case when c is not null then a / na end, 8) + 0.0 as orth_r1, round(case when c is not null then b / nb end, 8) + 0.0 as orth_r5, round(c / nc, 8) + 0.0 as orth_r20 from d, n""",
)
def panel_orthogonal(spark, d):
    rows = panel(spark, d)
    m = algebra.moments(rows, FEATURES[:3])
    return rounded(algebra.transformed(rows, m, algebra.gram_schmidt(m)).select("code", "date", *(f"orth_{f}" for f in FEATURES[:3])), "code", "date", digits=8)


@register(
    "panel_symmetric",
    f"""with {_PANEL}, ok as (select * from pan where r1 is not null and r5 is not null), m as (select avg(r1) as m1, avg(r5) as m5, var_pop(r1) as a, covar_pop(r1, r5) as b, var_pop(r5) as d from ok), r as (select *, sqrt(a * d - b * b) as s, sqrt(a + d + 2 * sqrt(a * d - b * b)) as t from m),
    i as (select m1, m5, (d + s) / t / s as p, -b / t / s as q, (a + s) / t / s as w from r)
    select code, date, round(case when r5 is not null then (r1 - m1) * p + (r5 - m5) * q end, 5) + 0.0 as sym_r1, round(case when r5 is not null then (r1 - m1) * q + (r5 - m5) * w end, 5) + 0.0 as sym_r5 from pan, i""",
)
def panel_symmetric(spark, d):
    rows = panel(spark, d)
    m = algebra.moments(rows, FEATURES[:2])
    return rounded(algebra.transformed(rows, m, algebra.symmetric(m), "sym_").select("code", "date", "sym_r1", "sym_r5"), "code", "date", digits=5)


@register(
    "panel_condition",
    f"""with {_PANEL}, m as (select count(*) as n, sum(r1 * r1) as a, sum(r1 * r5) as b, sum(r5 * r5) as d from pan where r1 is not null and r5 is not null), e as (select n, (a + d) / 2 as h, sqrt((a - d) * (a - d) / 4 + b * b) as k from m)
    select n, round(sqrt((h + k) / (h - k)), 6) as condition from e""",
    dates=(),
)
def panel_condition(spark, d):
    m = algebra.moments(panel(spark, d), FEATURES[:2])
    return spark.createDataFrame([(m.n, round(algebra.condition_number(m), 6))], "n long, condition double")


@register(
    "model_penalty_path",
    f"""with {_PANEL}, ok as (select spread as x1, size as x2, y, row_number() over (order by date, code) as k, count(*) over () as n from pan where spread is not null and size is not null and y is not null), p as (select *, k <= greatest(8, n * 2 // 3) as head from ok),
    h as (select count(*) as n, avg(x1) as u1, avg(x2) as u2, avg(y) as uy, var_pop(x1) * count(*) as a, covar_pop(x1, x2) * count(*) as b, var_pop(x2) * count(*) as d, covar_pop(x1, y) * count(*) as c1, covar_pop(x2, y) * count(*) as c2 from p where head),
    f as (select *, unnest([0.0, 0.1, 1.0, 5.0, 10.0]) as penalty from h), e as (select *, (a + penalty) * (d + penalty) - b * b as det from f), s as (select penalty, n, uy, u1, u2, (c1 * (d + penalty) - c2 * b) / det as b1, (c2 * (a + penalty) - c1 * b) / det as b2 from e),
    w as (select penalty, n, round(uy - b1 * u1 - b2 * u2, 6) as level, round(b1, 6) as b1, round(b2, 6) as b2 from s), t as (select penalty, any_value(w.n) as train_n, count(*) as test_n, avg((level + b1 * x1 + b2 * x2 - y) ** 2) as mse from w, p where not head group by 1)
    select cast(penalty as double) as penalty, train_n, test_n, round(mse, 4) as mse, mse = min(mse) over () as selected from t""",
    dates=(),
)
def model_penalty_path(spark, d):
    return algebra.penalty_path(panel(spark, d), ["spread", "size"], "y").withColumn("mse", F.round("mse", 4))


@register(
    "model_complete_panel",
    f"""with {_PANEL}, n as (select count(*) as n, count(rare) as rare, greatest(8, least(40, count(*) // 4)) as enough from pan), w as (select count(*) as rows from pan where r1 is not null and r5 is not null and r20 is not null and y is not null)
    select unnest(['r1', 'r5', 'r20', 'spread', 'size', 'SUMP5', 'flat']) as feature, unnest(['kept', 'kept', 'kept', 'kept', 'kept', 'sum_identity', 'constant']) as status, rows as complete_rows from w
    union all select 'rare', case when rare < enough then 'sparse' else 'kept' end, rows from n, w""",
    dates=(),
)
def model_complete_panel(spark, d):
    active, dropped, n = algebra.complete_columns(panel(spark, d), [*FEATURES, "SUMP5", "flat", "rare"], "y")
    return spark.createDataFrame([*((f, "kept", n) for f in active), *((f, why, n) for f, why in dropped)], "feature string, status string, complete_rows long")


@register(
    "model_collinear",
    f"""with {_PANEL}, q as (select *, r1 + r5 as r1_r5 from pan where r1 is not null and r5 is not null and r20 is not null and y is not null), m as (select corr(r1, r5) as ab, corr(r1, r1_r5) as ac, corr(r5, r1_r5) as bc, abs(corr(r1, y)) as ya, abs(corr(r5, y)) as yb, abs(corr(r1_r5, y)) as yc from q),
    p as (select unnest([struct_pack(v := abs(ab), a := 'r1', b := 'r5', c := ab, x := ya, z := yb), struct_pack(v := abs(ac), a := 'r1', b := 'r1_r5', c := ac, x := ya, z := yc), struct_pack(v := abs(bc), a := 'r5', b := 'r1_r5', c := bc, x := yb, z := yc)], recursive := true) from m),
    o as (select *, case when x >= z then b else a end as dropped, case when x >= z then a else b end as kept, row_number() over (order by v desc, a desc, b desc) as k from p where v >= 0.5)
    select dropped, kept, a || '~' || b as pair, round(c, 5) as corr from o x where not exists (select 1 from o y where y.k < x.k and (y.dropped = x.a or y.dropped = x.b) and not exists (select 1 from o z where z.k < y.k and (z.dropped = y.a or z.dropped = y.b)))""",
    dates=(),
)
def model_collinear(spark, d):
    rows = panel(spark, d).withColumn("r1_r5", c("r1") + c("r5")).where("r20 is not null")
    m = algebra.moments(rows, ["r1", "r5", "r1_r5", "y"])
    return spark.createDataFrame([(a, b, pair, round(v, 5)) for a, b, pair, v in algebra.without_collinear(m, "y", threshold=0.5)], "dropped string, kept string, pair string, corr double")


#: The mean return of all suppliers and that of the suppliers of region 0, by date.
_FACTORS = f"""{_RET}, q as (select code, date, ret from r where ret is not null), f as (select date, avg(ret) as market, avg(ret) filter (where n_regionkey = 0) as region from q join supplier on code = s_suppkey join nation on s_nationkey = n_nationkey group by 1)"""


@register(
    "risk_attribution",
    f"""with {_FACTORS}, j as (select code, market as a, region as b, ret as y from q join f using (date) where region is not null),
    m as (select code, count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as va, covar_pop(a, b) as ab, var_pop(b) as vb, covar_pop(a, y) as ay, covar_pop(b, y) as by_, var_pop(y) as vy from j group by 1 having count(*) > 3),
    s as (select *, va * vb - ab * ab as det from m), c as (select *, (ay * vb - by_ * ab) / det as ba, (by_ * va - ay * ab) / det as bb from s), e as (select *, (vy - ba * ay - bb * by_) * n as rest, ba * (va * ba + ab * bb) * n / (n - 1) as ca, bb * (ab * ba + vb * bb) * n / (n - 1) as cb from c)
    select code, n, round(my - ba * ma - bb * mb, 5) as alpha, round(1 - rest / (vy * n), 5) as r2, round(ba, 4) as beta_market, round(bb, 4) as beta_region, round(ba / sqrt(rest / (n - 3) * vb / det / n), 3) as t_market, round(bb / sqrt(rest / (n - 3) * va / det / n), 3) as t_region,
      round(ca + cb, 5) as systematic, round(rest / (n - 1), 5) as idiosyncratic, round(ca + cb + rest / (n - 1), 5) as total, round(ca / (ca + cb), 4) as share_market from e""",
    dates=(),
)
def risk_attribution(spark, d):
    """Suppliers with four dates or more."""
    r = returns(spark, d)
    of = B.read(spark, d, "supplier").join(F.broadcast(B.read(spark, d, "nation")), c("s_nationkey") == c("n_nationkey")).select(c("s_suppkey").alias("code"), "n_regionkey")  # nations are 25 rows
    factors = r.join(of, "code").groupBy("date").agg(F.avg("ret").alias("market"), F.avg(F.when(c("n_regionkey") == 0, c("ret"))).alias("region"))
    out = algebra.attributed(r, factors, ["market", "region"]).where("n > 3")
    cell = lambda i, name, digits: F.round(c("factors")[i][name], digits)
    return out.select(
        "code", "n", F.round("alpha", 5).alias("alpha"), F.round("r2", 5).alias("r2"), cell(0, "beta", 4).alias("beta_market"), cell(1, "beta", 4).alias("beta_region"), cell(0, "t", 3).alias("t_market"), cell(1, "t", 3).alias("t_region"),
        *(F.round(x, 5).alias(x) for x in ("systematic", "idiosyncratic", "total")), cell(0, "share", 4).alias("share_market"),
    )


_SHRUNK = f"""with {_grouped_sql("n_regionkey")}, k as (select count(distinct code) as k from q), d as (select date from q, k group by date, k having count(*) = k), x as (select code, date, ret - avg(ret) over (partition by code) as x from q join d using (date)),
  s as (select a.code as a, b.code as b, count(*) as n, avg(a.x * b.x) as cov from x a join x b on a.date = b.date and a.code <= b.code group by 1, 2), y as (select avg(m * m) as norm2, avg(f) as fourth, count(*) as t from (select sum(x * x) as m, sum(x * x * x * x) as f from x group by date)),
  z as (select sum(cov * cov * case when a = b then 1 else 2 end) as al, sum(case when a = b then cov * cov end) as dg, sum(case when a = b then cov end) as tr, max(k) as k from s, k),
  i as (select 'diagonal' as target, (norm2 - al - (fourth - dg)) / (t * (al - dg)) as v, tr, k from y, z union all select 'identity', (norm2 - al - (norm2 - tr * tr) / k) / (t * (al - tr * tr / k)), tr, k from y, z), g as (select target, greatest(0, least(1, v)) as delta, tr / k as mean from i)
  select target, a, b, n, round(delta * case when a <> b then 0 when target = 'diagonal' then cov else mean end + (1 - delta) * cov, 8) as cov, round(delta, 6) as shrinkage from s, g"""


@register("risk_shrinkage", _SHRUNK, dates=())
def risk_shrinkage(spark, d):
    r = grouped(spark, d, "n_regionkey")
    both = [covariance.ledoit_wolf(r, target).withColumn("target", F.lit(target)) for target in ("diagonal", "identity")]
    return both[0].unionByName(both[1]).select("target", "a", "b", "n", F.round("cov", 8).alias("cov"), F.round("shrinkage", 6).alias("shrinkage"))
