"""Point-in-time: entity = event user, evidence tiers by event type; lifecycle windows of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.operators import pit
from workload.registry import day, query, table

CUTOFFS = """ev as (select user_id || ' ' || hour(ts) || ' ' || dayofweek(ts) as entity_id, case event_type when 'purchase' then 1 when 'signup' then 2 when 'view' then 3 end as tier, cast(ts as date) as cutoff_date, event_id as doc_id, event_type as source
  from events where event_type in ('purchase', 'signup', 'view')),
top as (select entity_id, min(tier) as tier from ev group by 1),
final as (select entity_id, count(distinct cutoff_date) as n, min(cutoff_date) as one, min(doc_id) as doc_id, min(source) as source, string_agg(distinct cast(cutoff_date as varchar), ',' order by cast(cutoff_date as varchar)) as dates
  from ev join top using (entity_id, tier) group by 1),
cutoffs as (select u.entity_id, case when n is null then 'missing' when n = 1 then 'resolved' else 'conflicting' end as cutoff_status, case when n = 1 then one end as cutoff_date,
  case when n = 1 then source end as cutoff_source, case when n = 1 then doc_id end as evidence_doc_id, coalesce(dates, '') as candidate_dates
  from (select distinct user_id || ' ' || hour(ts) || ' ' || dayofweek(ts) as entity_id from events) u left join final using (entity_id))"""


# An entity is a user at an hour of a weekday: few evidence rows each, so every status occurs and all events take part.
def entity():
    return F.concat_ws(" ", "user_id", F.hour("ts"), F.dayofweek("ts") - 1).alias("entity_id")


def cutoffs(spark, d):
    ev = table(spark, d, "events").where("event_type in ('purchase', 'signup', 'view')")
    tier = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    evidence = ev.select(entity(), tier.alias("tier"), F.to_date("ts").alias("cutoff_date"), F.col("event_id").alias("doc_id"), F.col("event_type").alias("source"))
    users = table(spark, d, "events").select(entity()).distinct()
    return pit.resolve_cutoff(users, evidence)


def user_events(spark, d):
    return table(spark, d, "events").select(entity(), "event_id", "ts", "value")


@query("resolve_cutoff", f"with {CUTOFFS} select entity_id, cutoff_status, cast(cutoff_date as varchar) as cutoff_date, cutoff_source, evidence_doc_id, candidate_dates from cutoffs")
def resolve_cutoff(spark, d):
    out = cutoffs(spark, d)
    return out.select("entity_id", "cutoff_status", day("cutoff_date"), "cutoff_source", "evidence_doc_id",
                      F.array_join(F.transform("candidate_dates", lambda x: F.date_format(x, "yyyy-MM-dd")), ",").alias("candidate_dates"))


@query("as_of_filter", f"""with {CUTOFFS} select event_id, user_id || ' ' || hour(ts) || ' ' || dayofweek(ts) as entity_id, coalesce(e.ts <= cutoff_date + interval '23 hours 59 minutes 59 seconds', false) as considered
from events e join cutoffs c on c.entity_id = user_id || ' ' || hour(ts) || ' ' || dayofweek(ts)""")
def as_of_filter(spark, d):
    return pit.as_of_filter(user_events(spark, d), cutoffs(spark, d), "ts").select("event_id", "entity_id", "considered")


@query("leak_check", "select event_id from events where event_id is null")
def leak_check(spark, d):
    days = cutoffs(spark, d)
    return pit.leak_check(pit.as_of_filter(user_events(spark, d), days, "ts"), days, "ts").select("event_id")


@query("leak_check_finds", f"""with {CUTOFFS} select event_id from events e join cutoffs c on c.entity_id = user_id || ' ' || hour(ts) || ' ' || dayofweek(ts)
where not coalesce(e.ts <= cutoff_date + interval '23 hours 59 minutes 59 seconds', false)""")
def leak_check_finds(spark, d):
    everything = user_events(spark, d).withColumn("considered", F.lit(True))
    return pit.leak_check(everything, cutoffs(spark, d), "ts").select("event_id")


def as_of_totals(events, days):
    """What is known of an entity at its cutoff: the number, sum and latest kind of its events."""
    known = pit.as_of_filter(events, days, "ts").where("considered")
    return known.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@query("leak_check_rebuild", "select cast(event_id as varchar) as entity_id, 'none' as perturbation from events where event_id is null")
def leak_check_rebuild(spark, d):
    days = cutoffs(spark, d)
    events = {"events": table(spark, d, "events").select(entity(), "event_id", "event_type", "value", "ts")}
    return pit.leak_check_rebuild(events, days, lambda tables: as_of_totals(tables["events"], days), "ts")


@query("leak_check_rebuild_finds", f"""with {CUTOFFS},
late as (select distinct c.entity_id from events e join cutoffs c on c.entity_id = user_id || ' ' || hour(ts) || ' ' || dayofweek(ts)
  where not coalesce(e.ts <= cutoff_date + interval '23 hours 59 minutes 59 seconds', false))
select entity_id, unnest(['future dropped', 'future changed']) as perturbation from late""")
def leak_check_rebuild_finds(spark, d):
    """A planted leak: one of the features is counted over all events, whatever the cutoff."""
    days = cutoffs(spark, d)

    def leaking(tables):
        kinds = tables["events"].groupBy("entity_id").agg(F.count(F.lit(1)).alias("seen"), F.max("event_type").alias("kind"), F.sum("event_id").alias("ids"))
        return kinds.join(as_of_totals(tables["events"], days), "entity_id", "left")

    events = {"events": table(spark, d, "events").select(entity(), "event_id", "event_type", "value", "ts")}
    return pit.leak_check_rebuild(events, days, leaking, "ts")


@query("lifecycle_window", """with o as (select o_custkey, cast(min(o_orderdate) as date) as lo, cast(max(o_orderdate) as date) as hi from orders group by 1),
e as (select c_custkey, case when c_mktsegment <> 'BUILDING' then lo end as application_date, case when c_mktsegment in ('MACHINERY', 'FURNITURE') then date_trunc('month', hi)::date end as period_start,
  case when c_acctbal > 0 then hi end as listing_date from customer left join o on o_custkey = c_custkey),
w as (select *, least(coalesce(listing_date + 30, date '2001-06-30'), date '2001-06-30') as upper_ from e)
select c_custkey, cast(greatest(coalesce(least(application_date - 60, period_start - 180), upper_ - 400), upper_ - 400) as varchar) as window_from, cast(upper_ as varchar) as window_to from w""")
def lifecycle_window(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    e = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("lo")).alias("application_date"),
        F.when(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), F.trunc("hi", "MM")).alias("period_start"), F.when(F.col("c_acctbal") > 0, F.col("hi")).alias("listing_date"))
    return pit.lifecycle_window(e, "2001-06-30").select("c_custkey", day("window_from"), day("window_to"))
