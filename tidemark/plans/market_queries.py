"""Codes, clocks, headlines and covariances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.panel import safe_div
from tidemark.operators import covariance, headlines, scalars
from tidemark.plans.panel_queries import c, rounded
from tidemark.plans.registry import register
from tidemark.plans.research_queries import _RET, returns
from tidemark.sources import bars as B


@register(
    "scalar_codes",
    """with s as (select p_partkey, case p_partkey % 4 when 0 then '300' when 1 then '688' when 2 then '600' else 'x' end || lpad(cast(p_partkey % 1000 as varchar), 3, '0') || '.sz' as raw, case when p_size % 9 = 0 then '*ST ' else '' end || p_brand as name from part)
    select p_partkey, nullif(regexp_extract(raw, '(\\d{6})', 1), '') as code, cast(case when upper(name) like '%ST%' then 4.5 when substr(regexp_extract(raw, '(\\d{6})', 1), 1, 3) in ('300', '301', '688', '689') then 19.5 else 9.5 end as double) as limit_pct from s""",
    dates=(),
)
def scalar_codes(spark, d):
    k = c("p_partkey") % 4
    raw = F.concat(F.when(k == 0, "300").when(k == 1, "688").when(k == 2, "600").otherwise("x"), F.lpad((c("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".sz"))
    s = B.read(spark, d, "part").select("p_partkey", scalars.bare_code(raw).alias("code"), F.concat(F.when(c("p_size") % 9 == 0, "*ST ").otherwise(""), c("p_brand")).alias("name"))
    return s.select("p_partkey", "code", scalars.limit_pct(c("code"), c("name")).alias("limit_pct"))


@register(
    "scalar_clocks",
    """with s as (select event_id, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then strftime(ts, '%Y/%m/%d %H:%M') when 2 then strftime(ts, '%Y-%m-%d') when 3 then strftime(ts, '%Y%m%d') else 'soon' end as raw from events)
    select event_id, coalesce(try_strptime(raw, '%Y-%m-%d %H:%M:%S'), try_strptime(raw, '%Y/%m/%d %H:%M'), try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y%m%d')) as published, case event_id % 5 when 0 then 'timestamp' when 1 then 'timestamp' when 2 then 'date_only' when 3 then 'date_only' end as quality from s""",
    dates=("published",),
)
def scalar_clocks(spark, d):
    k, ts = c("event_id") % 5, c("ts")
    raw = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(ts, "yyyy/MM/dd HH:mm")).when(k == 2, F.date_format(ts, "yyyy-MM-dd")).when(k == 3, F.date_format(ts, "yyyyMMdd")).otherwise("soon")
    at, quality = scalars.publish_clock(c("raw"))
    return B.read(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", at.alias("published"), quality.alias("quality"))


@register(
    "scalar_forecasts",
    """with s as (select event_id, value / 50 - 1 as a, case when event_id % 3 <> 0 then value / 40 - 2 end as b from events)
    select event_id, round(((1 + a / 100) * (1 + coalesce(b, 0) / 100) - 1) * 100, 8) + 0.0 as both_legs, round(((1 + a / 100) / (1 + b / 100) - 1) * 100, 8) + 0.0 as remaining, round((a * 0.6 + coalesce(b * 0.4, 0)) / case when b is null then 0.6 else 1.0 end, 8) + 0.0 as fused,
    case when b is not null and abs(b) > 1e-12 then round(greatest(0.05, least(0.25, least(1, greatest(0, 0.55 - 0.45 / (abs(a) / abs(b)))) / 2)), 4) else 0.15 end as kelly from s where abs(a) > 0.001""",
    dates=(),
)
def scalar_forecasts(spark, d):
    s = B.read(spark, d, "events").select("event_id", (c("value") / 50 - 1).alias("a"), F.when(c("event_id") % 3 != 0, c("value") / 40 - 2).alias("b")).where("abs(a) > 0.001")
    a, b = c("a"), c("b")
    out = s.select("event_id", scalars.compound_pct(a, F.coalesce(b, F.lit(0.0))).alias("both_legs"), scalars.remaining_pct(a, b).alias("remaining"), scalars.fused([(a, 0.6), (b, 0.4)]).alias("fused"), scalars.kelly(F.lit(0.55), safe_div(F.abs(a), F.abs(b))).alias("kelly"))
    return rounded(out, "event_id", digits=8)


#: Headlines of the events: a code's titles repeat, some have a bare date, and fetching takes up to three days.
_HEAD = """h as (select user_id as code, event_type || ' ' || cast(event_id % 40 as varchar) as title, case when event_id % 4 = 0 then date_trunc('day', ts) else ts end as published_at, case when event_id % 4 = 0 then 'date_only' else 'timestamp' end as clock_quality, ts + to_hours(cast(event_id % 72 as integer)) as fetched_at from events),
u as (select *, sha1(regexp_replace(title, '\\s+', '', 'g')) as title_hash from h qualify row_number() over (partition by code, title_hash order by case when clock_quality = 'timestamp' then 0 else 1 end, published_at, fetched_at, title) = 1)"""


def titles(spark, d):
    e = B.read(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    bare = c("event_id") % 4 == 0
    return e.select(
        c("user_id").alias("code"), F.concat_ws(" ", "event_type", (c("event_id") % 40).cast("string")).alias("title"), F.when(bare, F.date_trunc("day", "ts")).otherwise(c("ts")).alias("published_at"),
        F.when(bare, "date_only").otherwise("timestamp").alias("clock_quality"), (c("ts") + F.make_interval(hours=(c("event_id") % 72).cast("int"))).alias("fetched_at"),
    )


@register("news_unique", f"with {_HEAD} select code, title, title_hash, published_at, clock_quality, fetched_at from u", dates=("published_at", "fetched_at"))
def news_unique(spark, d):
    return headlines.unique(titles(spark, d))


@register(
    "news_decision_days",
    f"""with {_HEAD}, cal as (select distinct cast(ts as date) as date from events where dayofweek(ts) between 1 and 5), r as (select code, title, greatest(case when clock_quality = 'date_only' then date_trunc('day', published_at) + interval 1 day else published_at end, fetched_at) as ready from u)
    select code, title, (select min(date) from cal where date + interval 575 minutes >= ready) as decision_date from r""",
    dates=("decision_date",),
)
def news_decision_days(spark, d):
    calendar = B.read(spark, d, "events").select(F.to_date("ts").alias("date")).where(F.dayofweek("date").between(2, 6)).distinct()
    return headlines.decision_days(headlines.unique(titles(spark, d)), calendar).select("code", "title", "decision_date")


@register("news_as_of", f"with {_HEAD} select code, title from u where cast(published_at as date) <= date '2024-01-15' qualify row_number() over (partition by code order by published_at desc, title) <= 3", dates=())
def news_as_of(spark, d):
    return headlines.as_of(headlines.unique(titles(spark, d)), "2024-01-15", 3).select("code", "title")


@register(
    "news_lexicon",
    "with s as (select conv_id, turn, case when contains(text, 'la') then 1 else 0 end + case when contains(text, 'der') then 1 else 0 end as g, case when contains(text, 'the') then 1 else 0 end + case when contains(text, 'que') then 1 else 0 end as b from conversations) select conv_id, turn, case when g is null then 0.0 else coalesce((g - b) / nullif(g + b, 0), 0.0) end as score from s",
    dates=(),
)
def news_lexicon(spark, d):
    return B.read(spark, d, "conversations").select("conv_id", "turn", (scalars.lexicon_score(c("text"), ["la", "der"], ["the", "que"]) + 0.0).alias("score"))


# Covariances of all suppliers' returns, averaged by date and by nation or region of the supplier, so that pairs stay few at any scale.


def _grouped_sql(key: str) -> str:
    return f"{_RET}, q as (select cast(coalesce({key}, -1) as bigint) as code, date, avg(greatest(-0.5, least(0.5, ret))) as ret, count(*) as members from r left join supplier on code = s_suppkey left join nation on s_nationkey = n_nationkey where ret is not null group by 1, 2)"


def grouped(spark, d, key):
    places = B.read(spark, d, "supplier").join(F.broadcast(B.read(spark, d, "nation")), c("s_nationkey") == c("n_nationkey"), "left").select(c("s_suppkey").alias("code"), c(key).cast("long").alias("place"))  # nations are 25 rows
    r = returns(spark, d).join(places, "code", "left").withColumn("ret", F.greatest(F.lit(-0.5), F.least(F.lit(0.5), c("ret"))))
    return r.groupBy(F.coalesce("place", F.lit(-1)).alias("code"), "date").agg(F.avg("ret").alias("ret"), F.count("*").alias("members"))


def _covariances(suffix: str, key: str) -> None:
    q = _grouped_sql(key)
    ewma = f"""{q}, o as (select date, row_number() over (order by date desc) - 1 as age from (select distinct date from q)), w as (select q.*, pow(0.5, age / 400.0) as w from q join o using (date)),
    cv as (select x.code as a, y.code as b, count(*) as n, sum(x.w * x.ret * y.ret) / sum(x.w) - sum(x.w * x.ret) / sum(x.w) * sum(x.w * y.ret) / sum(x.w) as cov from w x join w y on x.date = y.date and x.code <= y.code group by 1, 2 having count(*) >= 10)"""
    plain = f"with {q} select x.code as a, y.code as b, count(*) as n, round(covar_pop(x.ret, y.ret), 8) as cov from q x join q y on x.date = y.date and x.code <= y.code group by 1, 2"
    risk = f"""with {ewma}, p as (select code, sum(members) / sum(sum(members)) over () as weight from q group by 1), f as (select a, b, cov from cv union all select b, a, cov from cv where a <> b),
    t as (select a, sum(cov * weight) as cw from f join p on b = code group by 1), v as (select sum(cw * weight) as var from t join p on a = code)
    select code, round(weight, 8) as weight, round(cw / sqrt(var), 7) as marginal, round(cw * weight / var, 7) as share from t join p on a = code, v"""

    @register(f"risk_covariance{suffix}", plain, dates=())
    def risk_covariance(spark, d):
        return covariance.pairs(grouped(spark, d, key)).withColumn("cov", F.round("cov", 8))

    @register(f"risk_ewma_covariance{suffix}", f"with {ewma} select a, b, n, round(cov, 8) as cov from cv", dates=())
    def risk_ewma_covariance(spark, d):
        return covariance.ewma(grouped(spark, d, key), half_life=400.0).withColumn("cov", F.round("cov", 8))

    @register(f"risk_contributions{suffix}", risk, dates=())
    def risk_contributions(spark, d):
        """A group's weight is its share of all returns."""
        r = grouped(spark, d, key)
        n = r.groupBy("code").agg(F.sum("members").alias("n"))
        weights = n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("code", (c("n") / c("all")).alias("weight"))  # one row
        out = covariance.contributions(covariance.ewma(r, half_life=400.0), weights)
        return out.select("code", F.round("weight", 8).alias("weight"), F.round("marginal", 7).alias("marginal"), F.round("share", 7).alias("share"))


_covariances("", "n_regionkey")
_covariances("_nations", "n_nationkey")
