"""Trailing features: index = daily order totals; monthly series = monthly order totals; many series = market segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import asof, series
from pitlake.tables import literal_table
from workload.events import order_index
from workload.registry import day, query, r6, table

SEGMENTS = """
points as (
  select c_mktsegment as series, cast(o_orderdate as date) as obs_date,
         cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
  from orders join customer on c_custkey = o_custkey group by 1, 2),
numbered as (select *, row_number() over (partition by series order by obs_date desc) as k from points)"""


def segment_points(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(
        F.col("c_mktsegment").alias("series"), F.to_date("o_orderdate").alias("obs_date")
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


def _trailing(out):
    return out.select("series", day("as_of_date"), r6("value"))


for _n in series.RETURN_WINDOWS.values():
    @query(f"trailing_return_{_n}", f"""with {SEGMENTS}
    select series, cast(max(obs_date) as varchar) as as_of_date,
      round((max(case when k = 1 then value end) / nullif(max(case when k = {_n + 1} then value end), 0) - 1) * 100, 6) as value
    from numbered where k <= {_n + 1} group by 1""")
    def trailing_return(spark, d, n=_n):
        return _trailing(series.trailing_return(segment_points(spark, d), n, ["series"]))


@query("trailing_volatility", f"""with {SEGMENTS},
steps as (select *, lag(value) over (partition by series order by obs_date) as prev from numbered where k <= 21)
select series, cast(max(obs_date) as varchar) as as_of_date,
  round(case when count(*) = 21 and not coalesce(bool_or(prev = 0), false) then stddev_samp(value / nullif(prev, 0) - 1) * 100 end, 6) as value
from steps group by 1""")
def trailing_volatility(spark, d):
    return _trailing(series.trailing_volatility(segment_points(spark, d), 20, ["series"]))


@query("trailing_max_drawdown", f"""with {SEGMENTS},
peaks as (select *, max(value) over (partition by series order by obs_date) as peak from numbered where k <= 60)
select series, cast(max(obs_date) as varchar) as as_of_date,
  round(case when count(*) = 60 then least(0, min((value / peak - 1) * 100)) end, 6) as value
from peaks group by 1""")
def trailing_max_drawdown(spark, d):
    return _trailing(series.trailing_max_drawdown(segment_points(spark, d), 60, ["series"]))


@query("latest_value", f"""with {SEGMENTS}
select series, cast(obs_date as varchar) as as_of_date, round(value, 2) as value from numbered where k = 1""")
def latest_value(spark, d):
    out = series.latest_value(segment_points(spark, d), ["series"])
    return out.select("series", day("as_of_date"), F.round("value", 2).alias("value"))


MONTHS = """
months as (
  select c_mktsegment as series, date_trunc('month', o_orderdate)::date as obs_date,
         cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
  from orders join customer on c_custkey = o_custkey group by 1, 2)"""


def segment_months(spark, d):
    return segment_points(spark, d).groupBy("series", F.trunc("obs_date", "MM").alias("obs_date")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


YOY = f"""{MONTHS},
latest as (select series, max(obs_date) as obs_date from months group by 1),
yoy as (
  select l.series, l.obs_date as as_of_date, (c.value / nullif(p.value, 0) - 1) * 100 as value
  from latest l join months c using (series, obs_date)
  left join months p on p.series = l.series and p.obs_date = l.obs_date - interval 1 year)"""


@query("yoy_by_month", f"with {YOY} select series, cast(as_of_date as varchar) as as_of_date, round(value, 6) as value from yoy")
def yoy_by_month(spark, d):
    return _trailing(series.yoy_by_month(segment_months(spark, d), ["series"]))


@query("spread_level_and_yoy", f"""with {SEGMENTS}, {YOY}
select n.series, cast(greatest(n.obs_date, y.as_of_date) as varchar) as as_of_date, round(n.value / 1000 - y.value, 6) as value,
  'daily,monthly' as source_codes
from numbered n join yoy y using (series) where k = 1""")
def spread_level_and_yoy(spark, d):
    points = segment_points(spark, d)
    level = series.latest_value(points, ["series"]).select(
        "series", "as_of_date", (F.col("value") / 1000).alias("value"), F.array(F.lit("daily")).alias("source_codes"))
    yoy = series.yoy_by_month(segment_months(spark, d), ["series"]).withColumn("source_codes", F.array(F.lit("monthly"), F.lit("daily")))
    out = series.spread(level, yoy, ["series"])
    return out.select("series", day("as_of_date"), r6("value"), F.array_join("source_codes", ",").alias("source_codes"))


# One as-of date per event day shifted into the order range, plus every ship date: thousands of dates at once.
CONTEXT = """
idx as (
  select cast(o_orderdate as date) as obs_date, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value
  from orders group by 1),
policy as (
  select cast(l_shipdate as date) as obs_date, cast(sum(cast(l_discount as decimal(9,2))) as double) / count(*) as value from lineitem group by 1),
overnight as (
  select cast(l_shipdate as date) as obs_date, cast(sum(cast(l_tax as decimal(9,2))) as double) / count(*) as value from lineitem
  where l_returnflag = 'A' group by 1),
cpi as (select date_trunc('month', obs_date)::date as obs_date, cast(sum(cast(value as decimal(18,2))) as double) as value from idx group by 1),
dates as (select distinct cast(l_shipdate as date) as as_of from lineitem),
roll as (
  select obs_date, value, row_number() over w as seen, lag(value) over w as prev,
    lag(value, 20) over w as l20, lag(value, 60) over w as l60, lag(value, 120) over w as l120 from idx window w as (order by obs_date)),
steps as (select *, value / nullif(prev, 0) - 1 as step from roll),
falls as (
  select a.obs_date, min((b.value / b.peak - 1) * 100) as fall
  from steps a join lateral (
    select c.value, max(c.value) over (order by c.seen) as peak from steps c where c.seen between a.seen - 59 and a.seen) b on true
  where a.seen >= 60 group by 1),
feats as (
  select s.obs_date, s.value as index_level, (value / nullif(l20, 0) - 1) * 100 as return_20d, (value / nullif(l60, 0) - 1) * 100 as return_60d,
    (value / nullif(l120, 0) - 1) * 100 as return_120d,
    case when seen > 20 then stddev_samp(step) over (order by s.obs_date rows between 19 preceding and current row) * 100 end as volatility_20d,
    case when f.fall is not null then least(0, f.fall) end as max_drawdown_60d
  from steps s left join falls f using (obs_date)),
yoy as (
  select c.obs_date, (c.value / nullif(p.value, 0) - 1) * 100 as yoy
  from cpi c left join cpi p on p.obs_date = c.obs_date - interval 1 year),
wide as (
  select d.as_of, f.obs_date as index_on, f.* exclude (obs_date), p.obs_date as policy_on, p.value as policy_rate,
    o.obs_date as overnight_on, o.value as overnight_rate, y.obs_date as yoy_on, y.yoy
  from dates d asof left join feats f on d.as_of >= f.obs_date asof left join policy p on d.as_of >= p.obs_date
  asof left join overnight o on d.as_of >= o.obs_date asof left join yoy y on d.as_of >= y.obs_date),
long as (
  select as_of, 'index_level' as feature, index_level as value, index_on as as_of_date from wide
  union all select as_of, 'return_20d', return_20d, index_on from wide
  union all select as_of, 'return_60d', return_60d, index_on from wide
  union all select as_of, 'return_120d', return_120d, index_on from wide
  union all select as_of, 'volatility_20d', volatility_20d, index_on from wide
  union all select as_of, 'max_drawdown_60d', max_drawdown_60d, index_on from wide
  union all select as_of, 'policy_rate', policy_rate, policy_on from wide
  union all select as_of, 'overnight_rate', overnight_rate, overnight_on from wide
  union all select as_of, 'yoy', yoy, yoy_on from wide
  union all select as_of, 'policy_rate_minus_yoy', policy_rate - yoy, greatest(policy_on, yoy_on) from wide)"""


def context_inputs(spark, d):
    lines = table(spark, d, "lineitem")

    def daily(rows, column):
        return rows.groupBy(F.to_date("l_shipdate").alias("obs_date")).agg(
            (F.sum(F.col(column).cast("decimal(9,2)")).cast("double") / F.count(F.lit(1))).alias("value"))

    index = order_index(spark, d)
    rates = {"policy_rate": daily(lines, "l_discount"), "overnight_rate": daily(lines.where("l_returnflag = 'A'"), "l_tax")}
    cpi = index.groupBy(F.trunc("obs_date", "MM").alias("obs_date")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return index, rates, cpi


@query("market_context", f"""with {CONTEXT}
select cast(as_of as varchar) as as_of, feature, round(value, 5) as value, cast(as_of_date as varchar) as as_of_date
from long where value is not null""")
def market_context(spark, d):
    dates = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("as_of")).distinct()
    out = series.market_context(*context_inputs(spark, d), dates)
    return out.select(day("as_of"), "feature", F.round("value", 5).alias("value"), day("as_of_date"))


@query("as_of_before", """
select e.event_id, e.user_id, cast(p.event_id as bigint) as previous_purchase, round(p.value, 6) as previous_value
from events e asof left join (select * from events where event_type = 'purchase') p
  on e.user_id = p.user_id and e.ts > p.ts""")
def as_of_before(spark, d):
    left = table(spark, d, "events").select("event_id", "user_id", "ts")
    right = table(spark, d, "events").where("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("at"), F.col("event_id").alias("previous_purchase"), F.col("value").alias("previous_value"))
    out = asof.as_of_join(left, right, ["user_id"], "ts", "at", ["previous_purchase", "previous_value"], strict=True, bucket="DAY")
    return out.select("event_id", "user_id", "previous_purchase", r6("previous_value"))


@query("as_of_at_or_before", """
select e.event_id, e.user_id, cast(p.event_id as bigint) as last_purchase
from events e asof left join (select * from events where event_type = 'purchase') p
  on e.user_id = p.user_id and e.ts >= p.ts""")
def as_of_at_or_before(spark, d):
    left = table(spark, d, "events").select("event_id", "user_id", "ts")
    right = table(spark, d, "events").where("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_purchase"))
    out = asof.as_of_join(left, right, ["user_id"], "ts", "at", ["last_purchase"], bucket="DAY")
    return out.select("event_id", "user_id", "last_purchase")


@query("exact_date_lookup", """
with idx as (
  select cast(o_orderdate as date) as obs_date, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value from orders group by 1)
select p_partkey as entity_id, cast(s.d as varchar) as start_date, round(i.value, 2) as value
from part left join (select l_partkey, min(cast(l_shipdate as date)) as d from lineitem group by 1) s on s.l_partkey = p_partkey
left join idx i on i.obs_date = s.d""")
def exact_date_lookup(spark, d):
    from workload.events import part_anchors

    out = asof.exact_date_lookup(part_anchors(spark, d), order_index(spark, d), [], "start_date", "obs_date", ["value"])
    return out.select("entity_id", day("start_date"), F.round("value", 2).alias("value"))


@query("fetch_watermarks", """
with last as (select c_mktsegment as series, max(cast(o_orderdate as date)) as d from orders join customer on c_custkey = o_custkey group by 1),
registry as (
  select distinct c_mktsegment as series, 'daily' as frequency from customer
  union all select r_name, 'monthly' from region),
need as (
  select series, frequency, coalesce(d + 1, date '2002-01-01' - case frequency when 'daily' then 260 else 400 end) as next_date
  from registry left join last using (series))
select series, frequency, cast(next_date as varchar) as next_date,
  cast(min(next_date) over (partition by frequency) as varchar) as batch_start from need""")
def fetch_watermarks(spark, d):
    segments = table(spark, d, "customer").select(F.col("c_mktsegment").alias("series"), F.lit("daily").alias("frequency")).distinct()
    regions = table(spark, d, "region").select(F.col("r_name").alias("series"), F.lit("monthly").alias("frequency"))
    out = series.fetch_watermarks(segment_points(spark, d), segments.union(regions), "2002-01-01")
    return out.select("series", "frequency", day("next_date"), day("batch_start"))


@query("calendar_gaps", """
with days as (select cast(unnest(generate_series(timestamp '1996-01-01', timestamp '1996-12-31', interval 1 day)) as date) as day),
holidays as (select date '1996-01-01' as day union all select date '1996-12-25')
select s_suppkey, cast(day as varchar) as missing_date from supplier cross join days
where dayofweek(day) not in (0, 6) and day not in (select day from holidays)
  and not exists (select 1 from lineitem where l_suppkey = s_suppkey and cast(l_shipdate as date) = day)""")
def calendar_gaps(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("obs_date"))
    holidays = literal_table(spark, [["1996-01-01"], ["1996-12-25"]], ["obs_date"], ["date"])
    out = series.calendar_gaps(points, table(spark, d, "supplier").select("s_suppkey"), "1996-01-01", "1996-12-31", holidays)
    return out.select("s_suppkey", day("missing_date"))
