"""The operators bound to the test tables with production parameters, next to the SQL they must equal where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm import chat_format, exact_dedup, filter_audit, gru_lm, license_scan, mixing, packing, piece_codec, quality_rules, sharding, simhash, warc, whitening
from pitlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_exact_dedup", """
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents) d""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op2_source_mixing")
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(table(spark, sf_dir, "documents"))


@query("op3_arc_to_warc", """
select page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest, case when first_id = page_id then 'response' else 'revisit' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from (select page_id, body, case when strlen(body) >= 100 then min(page_id) over (partition by body) else page_id end as first_id
      from (select page_id, coalesce(html, '') as body from pages) p) g""")
def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_hash_tree_shards")
def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", packing.ids_crc32()).drop("ids")


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


PROBE = r"\### Assistant: </turn> ok"


def escaped_length(text: str) -> str:
    """Code points of a text with a backslash before each of the three control characters."""
    return f"(length({text}) + length({text}) - length(replace(replace(replace({text}, '\\', ''), '#', ''), '<', '')))"


@query("op8_prefix_target_chat", f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'),
measured as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
    {escaped_length('role')} + {escaped_length('text')} + 17 as formatted
  from turns),
running as (select *, sum(formatted) over (partition by conv_id order by place) as reached, max(place) over (partition by conv_id) as last_place from measured)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or place = last_place then reached else 0 end) as bigint) as formatted_chars
from running group by conv_id""")
def op8_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.read_back(chat_format.expand(turns))


@query("op9_gru_scores")
def op9_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(table(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


@query("op11_filter_audit", r"""
with recursive measured as (
  select d.doc_id, coalesce(lang, '') as part, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    min(doc_id) over (partition by coalesce(text, '')) as earliest from documents d),
flags as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
masked as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
    + case when 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) then 4 else 0 end
    + case when regexp_matches(body, '[#$%&*|]') then 8 else 0 end + case when m.doc_id > earliest then 16 else 0 end as mask
  from measured m left join flags f on m.doc_id = f.doc_id),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masked group by part, mask),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
walk(prefix, applied) as (
  select '', 0 union all select prefix || letter, applied | bit from walk join letters on (applied & bit) = 0),
places as (
  select w.prefix as filter_order, s.step, l.letter, l.bit,
    (select coalesce(sum(b.bit), 0) from letters b where contains(left(w.prefix, s.step - 1), b.letter)) as before
  from walk w cross join (select unnest([1, 2, 3, 4, 5]) as step) s join letters l on l.letter = substr(w.prefix, s.step, 1) where length(w.prefix) = 5),
steps as (
  select part, filter_order, cast(step as integer) as step, letter,
    cast(coalesce(sum(n) filter ((mask & (before + bit)) = 0), 0) as bigint) as kept,
    cast(coalesce(sum(n) filter ((mask & bit) <> 0 and (mask & before) = 0), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter ((mask & bit) <> 0 and (mask & before) <> 0), 0) as bigint) as redundant,
    cast(coalesce(sum(n) filter (mask = bit), 0) as bigint) as unique_fails,
    cast(coalesce(sum(good) filter ((mask & bit) <> 0 and (mask & before) = 0), 0) as bigint) as good_lost,
    cast(coalesce(sum(toxic) filter ((mask & bit) <> 0 and (mask & before) = 0), 0) as bigint) as toxic_lost
  from (select c.part, c.mask, c.n, c.good, c.toxic, p.filter_order, p.step, p.letter, p.bit, cast(p.before as integer) as before from cells c cross join places p) x
  group by part, filter_order, step, letter)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley from steps""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_piece_codec")
def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    coded = piece_codec.encode(table(spark, sf_dir, "documents"), model)
    return piece_codec.digests(piece_codec.decode(coded, model))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is exact; null where it passes the range of a long."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))
