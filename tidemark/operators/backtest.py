"""Back-tests: set-based signals, and state that is carried along one entity's days."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.panel import Panel, safe_div

P = Panel()


def overlapping_trades(rows: DataFrame, score: str, floor: float, hold: int, cost_pct: float, limit_pct: float = 9.5) -> DataFrame:
    """``code, date, entry, exit, ret_pct``: a signal buys at the next open, unless that opens at the upper limit, and sells at the open ``hold`` rows on."""
    entry, leave = F.lead("open", 1).over(P.series), F.lead("open", 1 + hold).over(P.series)
    blocked = safe_div(entry, F.col("close")) - 1 >= limit_pct / 100
    trades = rows.select("code", "date", F.col(score).alias("score"), entry.alias("entry"), leave.alias("exit"), blocked.alias("blocked"))
    trades = trades.where((F.col("score") >= floor) & F.col("entry").isNotNull() & F.col("exit").isNotNull() & ~F.coalesce("blocked", F.lit(True)))
    return trades.select("code", "date", "entry", "exit", ((safe_div(F.col("exit"), F.col("entry")) - 1) * 100 - cost_pct).alias("ret_pct"))


def walk(rows: DataFrame, score: str, floor: float, hold: int, cost_pct: float, limit_pct: float = 9.5, defer: int = 3) -> DataFrame:
    """Trades of each code one after another: as above, but the next entry waits for the exit, and an exit at the lower limit waits up to ``defer`` rows."""

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("date", ignore_index=True)
        opens, closes, scores = bars.open.tolist(), bars.close.tolist(), bars.score.tolist()
        out, i, n = [], 0, len(bars)
        while i + 1 + hold < n:
            value, entry, last = scores[i], opens[i + 1], closes[i]
            if value is None or value != value or value < floor or not entry or not last or entry / last - 1 >= limit_pct / 100:
                i += 1
                continue
            j = i + 1 + hold
            for _ in range(defer):
                if j + 1 < n and closes[j - 1] and opens[j] / closes[j - 1] - 1 <= -limit_pct / 100:
                    j += 1
                else:
                    break
            out.append((bars.code[0], bars.date[i], bars.date[j], entry, opens[j], (opens[j] / entry - 1) * 100 - cost_pct))
            i = j
        return pd.DataFrame(out, columns=["code", "date", "exit_date", "entry", "exit", "ret_pct"])

    kind = dict(rows.dtypes)["code"]
    data = rows.select("code", "date", "open", "close", F.col(score).alias("score"))
    return data.groupBy("code").applyInPandas(run, f"code {kind}, date date, exit_date date, entry double, exit double, ret_pct double")


def trade_summary(trades: DataFrame, *by: str) -> DataFrame:
    """Number, share of gains, mean and compounded return of trades."""
    r = F.col("ret_pct")
    return trades.groupBy(*by).agg(F.count("*").alias("n"), (F.avg((r > 0).cast("double")) * 100).alias("win_pct"), F.avg(r).alias("mean_pct"), ((F.exp(F.sum(F.log1p(r / 100))) - 1) * 100).alias("total_pct"))


def top_k_curve(rows: DataFrame, score: str, k: int, hold: int) -> DataFrame:
    """``date, n, ret_pct, curve``: mean forward return of the k best scores of each date, and its running product."""
    ahead = (safe_div(F.lead("open", 1 + hold).over(P.series), F.lead("open", 1).over(P.series)) - 1) * 100
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "code"))
    picked = rows.withColumn("ahead", ahead).where(F.col("ahead").isNotNull() & F.col(score).isNotNull()).withColumn("place", place).where(F.col("place") <= k)
    days = picked.groupBy("date").agg(F.count("*").alias("n"), F.avg("ahead").alias("ret_pct"))
    # One row a date is left for the running product.
    return days.withColumn("curve", F.exp(F.sum(F.log1p(F.col("ret_pct") / 100)).over(Window.orderBy("date"))))


def first_in_first_out(buys: DataFrame, sells: DataFrame) -> DataFrame:
    """``code, buy_id, sell_id, quantity``: which buys (code, id, at, quantity; at is a date) each sale takes, oldest first.

    A sale takes only what was bought on an earlier date and not sold before, and less than it asks for if there is less: with B bought before
    it and Q asked for up to it, the sold total is Q plus the least B - Q so far, if that is negative. Running totals of both sides
    then cut a code's quantity into stretches; each belongs to the buy and the sale whose totals next reach its end.
    """
    by_time = Window.partitionBy("code").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    day = F.datediff("at", F.lit("1970-01-01"))
    earlier = Window.partitionBy("code").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    rows = lambda side, sale: side.where("quantity > 0 and at is not null").select("code", "id", "at", day.alias("day"), F.col("quantity").cast("long").alias("quantity"), F.lit(sale).alias("sale"))
    both = rows(buys, False).unionByName(rows(sells, True)).withColumn("bought", F.coalesce(F.sum(F.when(~F.col("sale"), F.col("quantity"))).over(earlier), F.lit(0)))
    asked = both.where("sale").withColumn("asked", F.sum("quantity").over(by_time))
    sold = asked.withColumn("end", F.col("asked") + F.least(F.lit(0), F.min(F.col("bought") - F.col("asked")).over(by_time)))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("code").orderBy("at", "id")), F.lit(0))
    sold = sold.withColumn("before", before).where("end > before")
    none = F.lit(None).cast("long")
    cuts = both.where("not sale").select("code", F.sum("quantity").over(by_time).alias("end"), F.col("id").alias("buy_id"), none.alias("sell_id"))
    cuts = cuts.unionByName(sold.select("code", "end", none.alias("buy_id"), F.col("id").alias("sell_id"))).groupBy("code", "end").agg(F.max("buy_id").alias("buy_id"), F.max("sell_id").alias("sell_id"))
    by_end = Window.partitionBy("code").orderBy("end")
    ahead = by_end.rowsBetween(0, Window.unboundedFollowing)
    size = F.col("end") - F.coalesce(F.lag("end").over(by_end), F.lit(0))
    out = cuts.select("code", F.first("buy_id", ignorenulls=True).over(ahead).alias("buy_id"), F.first("sell_id", ignorenulls=True).over(ahead).alias("sell_id"), size.alias("quantity"))
    return out.where("buy_id is not null and sell_id is not null")
