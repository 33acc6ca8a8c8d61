"""Whole pipelines and streams over the test tables."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from pitlake.operators import evidence, pit, quality
from pitlake.plans import history
from pitlake.session import stage, use_checkpoints
from pitlake.sources import sinks, state_table
from pitlake.streaming import outbox, records
from workload.evidence import FIRST, ROWS, offering_pages
from workload.inputs import DISCLOSURES
from workload.pit import CUTOFFS, cutoffs
from workload.ratios import fin, people
from workload.registry import day, derive, query, table
from workload.series import context_inputs


def scratch(spark, name: str) -> str:
    return f"{use_checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# The pages all speak of April 2024; documents are moved there so that cutoffs cut.
def moved(c):
    return F.timestamp_add("DAY", F.datediff(F.lit("2024-04-12"), F.lit("1998-06-30")), F.col(c))


def snapshot_observations(pages, fields=None):
    both = evidence.extract_observations(pages, ["entity_id", "published_at", "document_type", "method"], fields)
    return both.withColumnRenamed("document_type", "source_type").withColumn("published_at", moved("published_at"))


def snapshot_inputs(spark, d):
    """Entities, documents, and what the cutoffs rest on: observations of the subscription's end and later announcements of it."""
    pages = offering_pages(spark, d)
    observations = snapshot_observations(pages, ("subscription_end_date",))
    results = stage(pages.where("document_type = 'ipo_results'").select("doc_id", "page_no", "text", "document_type", "entity_id", F.lit("kap").alias("source_system")), "results")
    later = evidence.post_offer_evidence(results, ["entity_id"])
    documents = derive(spark, d, DISCLOSURES).select(
        F.col("o_custkey").alias("entity_id"), F.substring("disclosure_id", 2, 20).alias("doc_id"), "title", "published_at", F.lit(True).alias("usable"),
        F.when(F.col("title") == "Onaylı İzahname", "approved_prospectus").when(F.col("title") == "Tasarruf Sahiplerine Satış Duyurusu", "investor_sale_announcement")
        .otherwise("other").alias("document_type"))
    return people(spark, d), documents.withColumn("published_at", moved("published_at")), observations, later


def known_observations(spark, d, cutoffs):
    """All fields, read only from the pages of documents that are considered; a document's pages share its date."""
    orders = table(spark, d, "orders")
    dated = orders.withColumn("_at", moved("o_orderdate")).withColumnRenamed("o_custkey", "entity_id")
    considered = pit.as_of_filter(dated, cutoffs, "_at").where("considered").withColumnRenamed("entity_id", "o_custkey").select(*orders.columns)
    return snapshot_observations(offering_pages(spark, d, considered))


SNAPSHOT_CUTOFFS = f"""with rows_ as ({ROWS}), {FIRST},
said as (select entity_id, document_type, arg_min(ln, (published_at, doc_id)) as ln from firsts where flag = 'A' and document_type <> 'other' group by 1, 2),
own as (select entity_id, count(distinct ln) as n, min(ln) as ln from said group by 1),
res as (select entity_id, count(distinct ln) as n, min(ln) as ln from (select entity_id, doc_id, arg_min(ln, page_no) as ln from rows_ where flag = 'R' and document_type = 'ipo_results' group by 1, 2) x group by 1)
select c_custkey as entity_id, case when own.n = 1 or (own.n is null and res.n = 1) then 'resolved' when own.n is null and res.n is null then 'missing' else 'conflicting' end as cutoff_status,
  case when own.n = 1 then '2024-04-1' || own.ln when own.n is null and res.n = 1 then '2024-05-1' || res.ln end as cutoff_date from customer left join own on own.entity_id = c_custkey left join res on res.entity_id = c_custkey"""


@query("snapshot_cutoffs", SNAPSHOT_CUTOFFS)
def snapshot_cutoffs(spark, d):
    entities, _, observations, later = snapshot_inputs(spark, d)
    return history.build_cutoffs(entities, observations, later).select("entity_id", "cutoff_status", day("cutoff_date"))


@query("snapshot_documents", f"""with cutoffs as ({SNAPSHOT_CUTOFFS}),
docs as (select o_custkey as entity_id, cast(o_orderkey as varchar) as doc_id, o_orderdate + to_days(cast(date '2024-04-12' - date '1998-06-30' as integer)) as published_at from orders)
select docs.entity_id, doc_id, coalesce(published_at <= cast(cutoff_date as date) + interval '23 hours 59 minutes 59 seconds', false) as considered
from docs join cutoffs on cutoffs.entity_id = docs.entity_id""")
def snapshot_documents(spark, d):
    entities, documents, observations, later = snapshot_inputs(spark, d)
    return history.snapshot_documents(documents, history.build_cutoffs(entities, observations, later)).select("entity_id", "doc_id", "considered")


@query("historical_snapshots")
def historical_snapshots(spark, d):
    entities, documents, observations, later = snapshot_inputs(spark, d)
    index, rates, monthly = context_inputs(spark, d)
    metrics = fin(spark, d).withColumn("published_at", F.make_timestamp_ntz(F.year("period_end"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)))
    rates = {"policy_rate": rates["policy_rate"], "tlref_rate": rates["overnight_rate"]}
    out = history.build_snapshots(
        entities, documents, observations, later, metrics, (index, rates, monthly), read_known=lambda cutoffs: known_observations(spark, d, cutoffs))
    return out.select("entity_id", "cutoff_status", day("cutoff_date"), "considered_documents", "excluded_documents", "signal",
                      F.round("total_score", 4).alias("total_score"), F.round("confidence_score", 4).alias("confidence_score"))


@query("summarize_dataset", f"""with {CUTOFFS} select 'cutoff_status' as dimension, cutoff_status as value, count(*) as n from cutoffs group by 2
union all select 'cutoff_source', cutoff_source, count(*) from cutoffs where cutoff_source is not null group by 2
union all select 'covered:cutoff_date', case when cutoff_date is null then 'false' else 'true' end, count(*) from cutoffs group by 2 union all select 'total', 'all', count(*) from cutoffs""")
def summarize_dataset(spark, d):
    path = scratch(spark, "snapshots")
    sinks.write_snapshot_dataset(cutoffs(spark, d), path, "v1")
    return quality.summarize_dataset(sinks.read_snapshot_dataset(spark, path, "v1"), ["cutoff_status", "cutoff_source"], ["cutoff_date"])


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


@query("stream_new_records", "select user_id, event_type, false as announced from events group by 1, 2")
def stream_new_records(spark, d):
    out, state = scratch(spark, "new"), scratch(spark, "new-state")
    records.finish(records.stream_new_records(event_stream(spark, d), ["user_id", "event_type"], out, state), state)
    return spark.read.parquet(out).select("user_id", "event_type", "announced")


@query("stream_changed", "select user_id, sha256(event_type) as content_hash from events group by 1, 2")
def stream_changed(spark, d):
    out, state = scratch(spark, "changed"), scratch(spark, "changed-state")
    hashed = event_stream(spark, d).select("user_id", F.sha2("event_type", 256).alias("content_hash"))
    records.stream_changed(hashed, ["user_id"], "content_hash", out, state).awaitTermination()
    return spark.read.parquet(out).select("user_id", "content_hash")


@query("deliver_changed", "select user_id, sha256(event_type) as content_hash from events where event_type <> 'error' group by 1, 2")
def deliver_changed(spark, d):
    sent, state = scratch(spark, "sent"), scratch(spark, "sent-state")
    hashed = event_stream(spark, d).select("user_id", "event_type", F.sha2("event_type", 256).alias("content_hash"))
    records.deliver_changed(hashed, ["user_id"], "content_hash", sent, state, lambda rows: rows.where("event_type <> 'error'")).awaitTermination()
    return spark.read.parquet(sent).select("user_id", "content_hash")


@query("stream_first_write_wins", """select user_id, cast(cast(ts as date) as varchar) as day, arg_min(event_id, event_id) as event_id from events group by user_id, cast(ts as date)""")
def stream_first_write_wins(spark, d):
    target, state = scratch(spark, "points"), scratch(spark, "points-state")
    points = event_stream(spark, d).select("user_id", F.to_date("ts").alias("day"), "event_id")
    records.stream_first_write_wins(points, ["user_id", "day"], ["event_id"], "day", target, state).awaitTermination()
    return spark.read.parquet(target).select("user_id", day("day"), "event_id")


# Content of every user's events; two users in three confirm after half an hour. Times in milliseconds; a day between attempts, three to live.
HALF_HOUR, DAY_MS = 1_800_000, 86_400_000


@query("timed_delivery", f"""
with recursive content as (select user_id, sha256(event_type) as h, epoch_us(ts) // 1000 as t, false as ok from events where ts is not null),
moments as (select * from content union all select user_id, h, t + {HALF_HOUR}, true from content where user_id % 3 <> 0),
mark as (select max(t) as w from moments),
numbered as (select *, row_number() over (partition by user_id, h order by t, ok) as n from moments where user_id % 3 <> 0),
walk(user_id, h, n, t, ok, sent, until, send) as (
  select user_id, h, n, t, ok, false, t + {DAY_MS}, true from numbered where n = 1
  union all
  select r.user_id, r.h, r.n, r.t, r.ok,
    case when r.ok then true when w.until <= r.t then false else w.sent end,
    case when r.ok then greatest(r.t + 3 * {DAY_MS}, case when w.sent and w.until > r.t then w.until else 0 end) when w.until <= r.t then r.t + {DAY_MS} else w.until end,
    not r.ok and w.until <= r.t
  from walk w join numbered r on r.user_id = w.user_id and r.h = w.h and r.n = w.n + 1),
cycles(user_id, h, t) as (
  select user_id, h, min(t) from content where user_id % 3 = 0 group by 1, 2
  union all
  select user_id, h, nxt from (select y.user_id, y.h, (select min(c.t) from content c where c.user_id = y.user_id and c.h = y.h and c.t >= y.t + 3 * {DAY_MS}) as nxt from cycles y) z where nxt is not null),
unanswered as (select user_id, h, case when k < 4 then 'send' else 'given_up' end as outcome, least(k, 3) as attempt, t + (k - 1) * {DAY_MS} as due from cycles, (select unnest([1, 2, 3, 4]) as k) a)
select user_id, h as content_hash, outcome, cast(attempt as integer) as attempt, due from unanswered, mark where due <= w
union all select user_id, h, 'send', 1, t from walk where send""")
def timed_delivery(spark, d):
    content = event_stream(spark, d).select("user_id", F.sha2("event_type", 256).alias("h"), F.col("ts").cast("timestamp").alias("at"))
    rows = F.array(F.struct("at", F.lit(False).alias("ok")), F.struct((F.col("at") + F.expr("interval 30 minutes")).alias("at"), F.lit(True).alias("ok")))
    moments = content.select("user_id", "h", F.inline(F.when(F.col("user_id") % 3 != 0, rows).otherwise(F.slice(rows, 1, 1))))
    out, state = scratch(spark, "due"), scratch(spark, "due-state")
    outbox.run(outbox.timed_delivery(moments, ["user_id"], "h", "at", "ok", "0 seconds", timedelta(days=3), timedelta(days=1)), out, state)
    found = spark.read.parquet(out)
    due = F.unix_millis(F.col("due").cast("timestamp"))
    return found.select("user_id", F.col("h").alias("content_hash"), "outcome", "attempt", due.alias("due"))


# Events arrive in three parts by day of the month; every tenth comes a part late, every other tenth two parts.
PART = "least(2, day(ts) // 11 + case event_id % 10 when 0 then 1 when 1 then 2 else 0 end)"
IN_TIME = f"""
with e as (select user_id, event_type, event_id, ts, {PART} as part from events),
marks as (select p.part, (select max(ts) from e where e.part < p.part) - interval 8 days as mark from (select unnest([0, 1, 2]) as part) p),
judged as (select e.*, mark, coalesce(ts < mark, false) as late from e join marks using (part)),
firsts as (select *, row_number() over (partition by part, user_id, event_type order by ts, event_id) as k from judged where not late),
a0 as (select * from firsts where part = 0 and k = 1),
a1 as (select * from firsts f where part = 1 and k = 1 and not exists (select 1 from a0 a where a.user_id = f.user_id and a.event_type = f.event_type and a.ts >= f.mark)),
a2 as (select * from firsts f where part = 2 and k = 1 and not exists (
  select 1 from (select * from a0 union all select * from a1) a where a.user_id = f.user_id and a.event_type = f.event_type and a.ts >= f.mark))"""


def arriving_events(spark, d):
    """(accepted rows, late rows) after three runs, each over what has arrived since the one before."""
    ev = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    part = F.expr(PART.replace("//", "div"))
    folder, out, late, state = (scratch(spark, name) for name in ("arrived", "in-time", "late", "in-time-state"))
    for i in range(3):
        ev.where(part == i).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ev.schema).parquet(folder)
        records.stream_in_time(stream, ["user_id", "event_type"], "ts", timedelta(days=8), ["event_id"], out, late, state).awaitTermination()
    return spark.read.parquet(out), spark.read.parquet(late)


@query("stream_in_time", IN_TIME + """
select user_id, event_type, event_id, part as batch from (select * from a0 union all select * from a1 union all select * from a2) a""")
def stream_in_time(spark, d):
    return arriving_events(spark, d)[0].select("user_id", "event_type", "event_id", F.col("batch").cast("bigint").alias("batch"))


@query("stream_late_rows", IN_TIME + " select user_id, event_type, event_id, part as batch, 'late' as reason from judged where late")
def stream_late_rows(spark, d):
    return arriving_events(spark, d)[1].select("user_id", "event_type", "event_id", F.col("batch").cast("bigint").alias("batch"), "reason")


@query("append_unseen_batches", """with days as (select user_id, cast(ts as date) as day, min(event_id) as event_id, min(event_id) filter (event_type = 'click') as click from events group by 1, 2)
select user_id, cast(day as varchar) as day, coalesce(click, event_id) as event_id from days""")
def append_unseen_batches(spark, d):
    """Clicks first, then everything: the second batch is looked up in the table that the first one made."""
    ev = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type")
    name = f"points_{uuid.uuid4().hex[:12]}"
    for batch in (ev.where("event_type = 'click'"), ev):
        state_table.append_unseen(batch.drop("event_type"), name, ["user_id", "day"], ["event_id"], scratch(spark, "points"), buckets=8)
    return spark.table(name).select("user_id", day("day"), "event_id")


@query("unseen_content", """select doc_id from documents where text is null or md5(text) not in (select md5(text) from documents where doc_id % 2 = 0 and text is not null)""")
def unseen_content(spark, d):
    """Documents whose content no document of an even number has."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("content"))
    name = f"known_{uuid.uuid4().hex[:12]}"
    state_table.append_unseen(docs.where("doc_id % 2 = 0"), name, ["content"], ["doc_id"], scratch(spark, "known"), buckets=8)
    return state_table.unseen(docs, name, ["content"]).select("doc_id")
