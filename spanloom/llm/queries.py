"""Registered queries of the training-data operators: op{N}_{name} over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, mixing, ngram, pii, quality, simhash, sketch, toxicity, urls
from spanloom.llm.common import bucket_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, forest).select(
        F.col("id").alias("doc_id"),
        (bucket_of(F.col("id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    message = F.struct("role", "text").alias("message")
    mapped = chat.canonical_turns(rows.unionByName(planted).select("conv_id", "turn", message))
    out = chat.format_turns(chat.turn_rows(mapped, order="turn"))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(32 + 2 * (length(role) + length(text)) - length(regexp_replace(role || text, '[\\<\[]', '', 'g')))::bigint as formatted_chars
from t group by conv_id
"""


def op4_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = bucket_of(F.col("id"), 7)
    out = ngram.score(table(spark, sf_dir, "documents"), part != 2, F.pmod(F.xxhash64("id"), F.lit(ngram.DELETED_SHARE)) == 0)
    return out.withColumnRenamed("id", "doc_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketch.compared(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"),
        (bucket_of(F.col("id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP8_SQL = """
with recursive counts as (select source, count(*) as n from documents group by source),
rates as (
  select source, (1.0::double * pow(n::double, 0.5::double) / (select sum(pow(n::double, 0.5::double)) from counts)) * (select sum(n) from counts)::double / n as rate from counts
),
steps(source, rate, k, logfact, total) as (
  select source, rate, 0, 0.0::double, exp(-rate) from rates
  union all
  select source, rate, k + 1, logfact + ln((k + 1)::double), total + exp((k + 1) * ln(rate) - rate - (logfact + ln((k + 1)::double)))
  from steps where k < ceil(rate + 12 * sqrt(rate) + 40)
),
cdf as (select source, list(total order by k) as cdf from steps group by source),
drawn as (
  select d.*, len(list_filter(cdf, lambda c: c < (('0x' || substr(md5('20260:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)) as repeats
  from documents d join cdf c on d.source is not distinct from c.source
)
select doc_id, text, lang, source, n_chars, unnest(range(1, repeats + 1))::int as copy, repeats::int as repeats from drawn where repeats > 0
"""


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day made from its id (the table has no dates)."""
    day = F.date_add(F.lit("2021-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(1461)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))


def _list_entries(captures: DataFrame) -> DataFrame:
    """Dated entries by rule: a quarter of the hosts (by MD5) added and removed on days of their digest, and three domains."""
    host = urls.host_of(F.col("url"))
    hosts = captures.select(host.alias("domain")).where("domain is not null").distinct().withColumn("m", F.md5("domain")).where("substr(m, 1, 1) < '4'")
    number = lambda a: F.conv(F.substring("m", a, 6), 16, 10).cast("long")
    since = F.date_add(F.lit("2021-01-01").cast("date"), F.pmod(number(2), F.lit(1200)).cast("int"))
    until = F.date_add(since, (F.pmod(number(8), F.lit(400)) + 1).cast("int"))
    own = hosts.select("domain", F.explode(F.array(F.struct(F.lit("add").alias("action"), since.alias("day")), F.struct(F.lit("remove").alias("action"), until.alias("day")))).alias("e"))
    own = own.select("domain", "e.action", "e.day", F.lit("hosts").alias("listed_by"))
    fixed = captures.sparkSession.sql(FIXED_ENTRIES)
    return own.unionByName(fixed)


FIXED_ENTRIES = """
select domain, action, cast(day as date) as day, listed_by from values
  ('example.net', 'add', '2022-03-01', 'domains'), ('example.net', 'remove', '2022-09-01', 'domains'), ('example.net', 'add', '2024-01-15', 'domains'),
  ('m.example.org', 'add', '2021-06-01', 'domains'), ('example.org', 'add', '2023-05-05', 'urgent'), ('example.org', 'remove', '2023-05-06', 'urgent')
  as t(domain, action, day, listed_by)
"""


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _captures(spark, sf_dir)
    out = urls.judged(captures, _list_entries(captures))
    return out.withColumn("fetched", F.col("fetched").cast("string")).withColumn("since", F.col("since").cast("string"))


OP9_SQL = r"""
with captures as (
  select page_id, nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') as host,
    (date '2021-01-01' + (page_id % 1461)::int)::date as fetched from pages
), digests as (select distinct host as domain, md5(host) as m from captures where host is not null and md5(host)[1] < '4'),
starts as (select domain, (date '2021-01-01' + (('0x' || substr(m, 2, 6))::bigint % 1200)::int)::date as since, (('0x' || substr(m, 8, 6))::bigint % 400 + 1)::int as days from digests),
valid as (
  select domain, 'hosts' as listed_by, since, (since + days)::date as until from starts
  union all select * from (values ('example.net', 'domains', date '2022-03-01', date '2022-09-01'), ('example.net', 'domains', date '2024-01-15', null),
    ('m.example.org', 'domains', date '2021-06-01', null), ('example.org', 'urgent', date '2023-05-05', date '2023-05-06'))
), hits as (
  select c.page_id, v.domain, v.listed_by, v.since,
    row_number() over (partition by c.page_id order by length(v.domain) desc, v.since desc, v.listed_by desc) as place
  from captures c join valid v on (c.host = v.domain or ends_with(c.host, '.' || v.domain)) and c.fetched >= v.since and (v.until is null or c.fetched < v.until)
)
select c.page_id, c.host, c.fetched::varchar as fetched, h.page_id is not null as blocked, h.domain, h.listed_by, h.since::varchar as since
from captures c left join hits h on c.page_id = h.page_id and h.place = 1
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_chat": op3_chat,
    "op4_ngram": op4_ngram,
    "op5_decontaminate": op5_decontaminate,
    "op6_sketch": op6_sketch,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_urls": op9_urls,
    "op10_pii": op10_pii,
}
ORACLES: dict[str, str] = {"op3_chat": OP3_SQL, "op8_mixing": OP8_SQL, "op9_urls": OP9_SQL}
