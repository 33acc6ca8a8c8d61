"""Event study: entity = part, anchor price = list price, closes from line items, index = daily order totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlake.operators import cohort, events
from pitlake.plans import outcomes
from workload.registry import day, query, r6, table


def part_prices(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("entity_id"), F.to_date("l_shipdate").alias("obs_date")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def supplier_prices(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("obs_date")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def order_index(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("obs_date")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


def part_anchors(spark, d) -> DataFrame:
    first = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(F.to_date("l_shipdate")).alias("start_date"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_retailprice").alias("offer_price"))
    return parts.join(first, parts.entity_id == first.l_partkey, "left").select("entity_id", "offer_price", "start_date")


def part_outcomes(spark, d) -> DataFrame:
    return events.build_outcomes(part_anchors(spark, d), part_prices(spark, d), order_index(spark, d))


def staged_outcomes(spark, d) -> DataFrame:
    return outcomes.market_outcomes(part_anchors(spark, d), part_prices(spark, d), order_index(spark, d))


PRICES = """
prices as (
  select l_partkey as entity_id, cast(l_shipdate as date) as obs_date, avg(l_extendedprice / l_quantity) as close
  from lineitem group by 1, 2),
idx as (
  select cast(o_orderdate as date) as obs_date, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
  from orders group by 1),
anchors as (
  select p_partkey as entity_id, p_retailprice as offer_price, min(cast(l_shipdate as date)) as start_date
  from part left join lineitem on l_partkey = p_partkey group by 1, 2)"""

OUTCOMES = PRICES + """,
inside as (
  select p.entity_id, p.obs_date, p.close, nullif(a.offer_price, 0) as offer, a.start_date,
         row_number() over (partition by p.entity_id order by p.obs_date) as rn
  from prices p join anchors a using (entity_id)
  where p.obs_date between a.start_date and a.start_date + 100),
walk as (
  select *, (close / offer - 1) * 100 as ret,
         (close / greatest(offer, max(close) over (partition by entity_id order by rn)) - 1) * 100 as fall
  from inside),
measures as (
  select entity_id, count(*) as cnt, max(obs_date) as last_date,
    max(case when rn = 1 then ret end) as r1, max(case when rn = 5 then ret end) as r5,
    max(case when rn = 20 then ret end) as r20, max(case when rn = 60 then ret end) as r60,
    max(case when rn = 1 then obs_date end) as d1, max(case when rn = 5 then obs_date end) as d5,
    max(case when rn = 20 then obs_date end) as d20, max(case when rn = 60 then obs_date end) as d60,
    case when max(rn) >= 5 and min(fall) is not null then least(0, min(case when rn <= 5 then fall end)) end as m5,
    case when max(rn) >= 20 and min(fall) is not null then least(0, min(case when rn <= 20 then fall end)) end as m20,
    case when max(rn) >= 60 and min(fall) is not null then least(0, min(case when rn <= 60 then fall end)) end as m60
  from walk group by 1),
based as (
  select a.*, (select i.value from idx i where i.obs_date < a.start_date order by i.obs_date desc limit 1) as base
  from anchors a),
outcomes as (
  select b.entity_id, b.offer_price, b.start_date, coalesce(m.cnt, 0) as cnt, m.last_date, m.r1, m.r5, m.r20, m.r60, m.m5, m.m20, m.m60,
    m.r1 - (i1.value / b.base - 1) * 100 as x1, m.r5 - (i5.value / b.base - 1) * 100 as x5,
    m.r20 - (i20.value / b.base - 1) * 100 as x20, m.r60 - (i60.value / b.base - 1) * 100 as x60
  from based b left join measures m using (entity_id)
  left join idx i1 on i1.obs_date = m.d1 left join idx i5 on i5.obs_date = m.d5
  left join idx i20 on i20.obs_date = m.d20 left join idx i60 on i60.obs_date = m.d60)"""


@query("event_outcomes", f"""with {OUTCOMES}
select entity_id, cast(start_date as varchar) as start_date, cast(cnt as bigint) as price_observation_count,
  cast(last_date as varchar) as last_price_observation_date,
  round(r1, 6) as return_1d, round(r5, 6) as return_5d, round(r20, 6) as return_20d, round(r60, 6) as return_3m,
  round(m5, 6) as max_drawdown_5d, round(m20, 6) as max_drawdown_20d, round(m60, 6) as max_drawdown_3m,
  round(x1, 6) as relative_1d, round(x5, 6) as relative_5d, round(x20, 6) as relative_20d, round(x60, 6) as relative_3m
from outcomes""")
def event_outcomes(spark, d):
    out = part_outcomes(spark, d)
    return out.select(
        "entity_id", day("start_date"), F.col("price_observation_count").cast("bigint"), day("last_price_observation_date"),
        *[r6(f"return_{h}") for h in events.HORIZONS], *[r6(f"max_drawdown_{h}") for h in events.DRAWDOWN_HORIZONS],
        *[r6(f"relative_{h}") for h in events.HORIZONS])


def _event_sql(measure: str) -> str:
    picks = {
        "return": "max(case when rn = {n} then ret end)",
        "max_drawdown": "case when max(rn) >= {n} then least(0, min(case when rn <= {n} then fall end)) end",
    }[measure]
    cols = ", ".join(f"round({picks.format(n=n)}, 6) as {measure}_{h}" for h, n in events.HORIZONS.items())
    return f"""with prices as (
      select l_suppkey as entity_id, cast(l_shipdate as date) as obs_date, avg(l_extendedprice / l_quantity) as close
      from lineitem group by 1, 2),
    anchors as (
      select entity_id, cast(sum(cast(close as decimal(18,6))) / count(*) as double) as offer from prices group by 1),
    walk as (
      select p.entity_id, p.close, row_number() over w as rn, (p.close / a.offer - 1) * 100 as ret,
        (p.close / greatest(a.offer, max(p.close) over (partition by p.entity_id order by p.obs_date)) - 1) * 100 as fall
      from prices p join anchors a using (entity_id) window w as (partition by p.entity_id order by p.obs_date))
    select entity_id, {cols} from walk group by 1"""


def _supplier_metrics(spark, d):
    prices = supplier_prices(spark, d)
    offers = prices.groupBy("entity_id").agg(
        (F.sum(F.col("close").cast("decimal(18,6)")).cast("double") / F.count("close")).alias("offer_price"))
    first = events.first_sessions(prices, max(events.HORIZONS.values()))
    return events.event_metrics(first.join(offers, "entity_id"))


@query("event_returns", _event_sql("return"))
def event_returns(spark, d):
    return _supplier_metrics(spark, d).select("entity_id", *[r6(f"return_{h}") for h in events.HORIZONS])


@query("event_drawdowns", _event_sql("max_drawdown"))
def event_drawdowns(spark, d):
    return _supplier_metrics(spark, d).select("entity_id", *[r6(f"max_drawdown_{h}") for h in events.HORIZONS])


@query("event_relative_returns", f"""with {OUTCOMES}
select entity_id, round(x1, 6) as relative_1d, round(x5, 6) as relative_5d, round(x20, 6) as relative_20d
from outcomes where r1 is not null""")
def event_relative_returns(spark, d):
    anchors = part_anchors(spark, d)
    inside = events.sessions_from_start(part_prices(spark, d), anchors)
    metrics = events.event_metrics(events.first_sessions(inside, 60)).join(anchors.select("entity_id", "start_date"), "entity_id")
    out = events.relative_returns(metrics, anchors, order_index(spark, d))
    return out.select("entity_id", *[r6(f"relative_{h}") for h in ("1d", "5d", "20d")])


# Decision dates 30 days after the own start: the target is a member of its own cohort and must be taken out.
TARGETS = OUTCOMES + """,
targets as (select entity_id as target_id, start_date + 30 as as_of from outcomes where start_date is not null),
members as (
  select t.target_id, t.as_of, o.entity_id, o.x5, o.r5
  from targets t join outcomes o on o.x5 is not null and o.entity_id <> t.target_id
   and o.start_date < t.as_of and t.as_of - o.start_date <= 90 and o.start_date + 9 <= t.as_of)"""


def _targets(settled):
    return settled.where(F.col("start_date").isNotNull()).select(
        F.col("entity_id").alias("target_id"), F.date_add("start_date", 30).alias("as_of"))


def _text_ids(settled):
    return settled.withColumn("entity_id", F.concat(F.lit("p"), F.col("entity_id")))


@query("cohort_members", f"""with {OUTCOMES},
dates as (select distinct start_date + 30 as as_of from outcomes where start_date is not null)
select cast(as_of as varchar) as as_of, entity_id, round(x5, 6) as relative_5d
from dates join outcomes o on o.x5 is not null and start_date < as_of and as_of - start_date <= 90 and start_date + 9 <= as_of""")
def cohort_members(spark, d):
    settled = staged_outcomes(spark, d)
    out = cohort.mature_outcomes(settled, _targets(settled).select("as_of"), "relative_5d")
    return out.select(day("as_of"), "entity_id", r6("relative_5d"))


@query("cohort_regime", f"""with {TARGETS},
reads as (
  select target_id, count(*) as n, median(x5) as med, avg(case when x5 > 0 then 1.0 else 0.0 end) as share from members group by 1)
select 'p' || t.target_id as target_id, cast(t.as_of as varchar) as as_of, cast(coalesce(n, 0) as bigint) as mature_count,
  case when coalesce(n, 0) < 3 then 'UNKNOWN' when share >= 0.55 then 'FAVORABLE' when share <= 0.45 then 'UNFAVORABLE' else 'NEUTRAL' end as status,
  case when n >= 3 then round(med, 6) end as median_return, case when n >= 3 then round(share, 6) end as positive_share
from targets t left join reads using (target_id)""")
def cohort_regime(spark, d):
    settled = _text_ids(staged_outcomes(spark, d))
    targets = _targets(settled).withColumn("target_id", F.upper("target_id"))
    out = outcomes.regimes(targets, settled)
    return out.select(F.lower("target_id").alias("target_id"), day("as_of"), F.col("mature_count").cast("bigint"), "status",
                      r6("median_return"), r6("positive_share"))


@query("cohort_observation", f"""with {TARGETS},
reads as (select target_id, count(*) as n, min(r5) as lo, median(r5) as med, max(r5) as hi from members where r5 is not null group by 1)
select 'p' || t.target_id as target_id, cast(coalesce(n, 0) as bigint) as comparable_count,
  round(lo / 100, 6) as observed_worst, round(med / 100, 6) as observed_median, round(hi / 100, 6) as observed_best
from targets t left join reads using (target_id)""")
def cohort_observation(spark, d):
    settled = _text_ids(staged_outcomes(spark, d))
    out = cohort.cohort_observation(_targets(settled), settled, "return_5d", maturity="relative_5d")
    return out.select("target_id", F.col("comparable_count").cast("bigint"),
                      *[r6(f"observed_{c}") for c in ("worst", "median", "best")])
