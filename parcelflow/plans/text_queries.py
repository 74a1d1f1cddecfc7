"""Scalar functions over whole tables: texts, addresses, dates and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address, dates, text
from ..operators import matching
from . import binding
from .catalogue import query


@query("address_normalize", """
with raw as (
  select c_custkey, c_custkey + 100 as num, c_nationkey + 1 as road, c_custkey % 4 as form, c_custkey % 37 + 1 as u, n_name from customer join nation on c_nationkey = n_nationkey)
select c_custkey, num || ' ' || case form when 3 then 'HWY ' || road || ' SW' else road || case form when 1 then ' ST' else ' AVE' end || ' NW' end as street,
       case form when 0 then cast(u as varchar) when 1 then 'BSMT' when 2 then cast(u as varchar) end as unit, case form when 0 then 'T6E 2B3' end as postal_code,
       'edmonton|ab|' || lower(num || ' ' || case form when 3 then 'HWY ' || road || ' SW' else road || case form when 1 then ' ST' else ' AVE' end || ' NW' end) as site_key,
       'edmonton|ab|' || lower(num || ' ' || case form when 3 then 'HWY ' || road || ' SW' else road || case form when 1 then ' ST' else ' AVE' end || ' NW' end) || case form when 0 then '|unit:' || u when 1 then '|unit:bsmt' when 2 then '|unit:' || u else '' end as address_key
from raw""")
def address_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in four spellings, made out of customers' keys."""
    c = F.col
    own = binding.table(spark, sf_dir, "customer").select("c_custkey", (c("c_custkey") + 100).cast("string").alias("num"), (c("c_nationkey") + 1).cast("string").alias("road"), (c("c_custkey") % 37 + 1).cast("string").alias("u"))
    spelled = [
        F.concat(F.lit("Unit "), c("u"), F.lit(", "), c("num"), F.lit(" "), c("road"), F.lit(" Avenue Northwest, Edmonton, AB T6E 2B3")),
        F.concat(F.lit("BSMT, "), c("num"), F.lit(" - "), c("road"), F.lit(" STREET N.W.")),
        F.concat(c("u"), F.lit(", "), c("num"), F.lit(" - "), c("road"), F.lit("TH AVENUE NORTH WEST")),
        F.concat(c("num"), F.lit(" - HIGHWAY "), c("road"), F.lit(" SW")),
    ]
    raw = own.withColumn("raw", F.element_at(F.array(*spelled), (c("c_custkey") % 4 + 1).cast("int")))
    return address.normalize(raw, "raw").select("c_custkey", "street", "unit", "postal_code", "site_key", "address_key")


@query("legacy_rekey", """
select o_orderkey, 'edmonton|ab|' || (o_custkey + 1) || ' 5 ave nw' as site_key, o_orderstatus <> 'F' as moved, case when o_orderstatus <> 'F' and o_orderpriority <> '1-URGENT' then null else o_custkey end as project_id from orders""")
def legacy_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys of an older rule (all but the finished orders' are wrong) against the present one."""
    c = F.col
    site = F.concat(F.lit("edmonton|ab|"), (c("o_custkey") + 1).cast("string"))
    own = binding.table(spark, sf_dir, "orders").select(
        "o_orderkey", c("o_custkey").alias("project_id"), F.concat((c("o_custkey") + 1).cast("string"), F.lit(" 5th Avenue NW")).alias("raw_address"),
        F.when(c("o_orderpriority") == "1-URGENT", "manual").otherwise("normalized-site-address").alias("match_reason"), F.concat(site, F.when(c("o_orderstatus") == "F", " 5 ave nw").otherwise(" 5th avenue nw")).alias("site_key"),
    )
    return matching.rekey_legacy(own).select("o_orderkey", "site_key", "moved", "project_id")


@query("site_match", """
with p as (select lpad(cast(c_custkey as varchar), 12, '0') as project_id, 'site' || c_nationkey as site_key, 'site' || c_nationkey || '|unit:' || (c_custkey % 7) as address_key from customer),
e as (select o_orderkey, case when o_orderstatus = 'P' and o_custkey % 5 = 0 then '' else 'site' || (o_custkey % 30) end as site_key, 'site' || (o_custkey % 30) || '|unit:' || (o_orderkey % 9) as address_key from orders),
a as (select site_key, min(project_id) as x from p group by 1), b as (select site_key, address_key, min(project_id) as y from p group by 1, 2)
select o_orderkey, coalesce(y, x) as project_id from e left join a using (site_key) left join b using (site_key, address_key)""")
def site_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    s = lambda col: col.cast("string")
    nation = F.concat(F.lit("site"), s(c("c_nationkey")))
    projects = binding.table(spark, sf_dir, "customer").select(F.lpad(s(c("c_custkey")), 12, "0").alias("project_id"), nation.alias("site_key"), F.concat(nation, F.lit("|unit:"), s(c("c_custkey") % 7)).alias("address_key"))
    site = F.concat(F.lit("site"), s(c("o_custkey") % 30))
    permits = binding.table(spark, sf_dir, "orders").select("o_orderkey", F.when((c("o_orderstatus") == "P") & (c("o_custkey") % 5 == 0), "").otherwise(site).alias("site_key"), F.concat(site, F.lit("|unit:"), s(c("o_orderkey") % 9)).alias("address_key"))
    return matching.match_sites(permits, projects).select("o_orderkey", "project_id")


@query("site_assign", """
with e as (select o_orderkey, case when o_orderpriority = '5-LOW' then '' else 'site' || o_custkey end as site_key, o_orderdate, case when o_orderstatus = 'P' then null else 'N' || (o_custkey % 25) end as nb from orders),
p as (select 'site' || c_custkey as site_key, lpad(cast(c_custkey as varchar), 12, '0') as pid from customer where c_mktsegment <> 'BUILDING'),
f as (select site_key, arg_min(coalesce(nb, ''), strftime(o_orderdate, '%Y%m%d') || lpad(cast(o_orderkey as varchar), 12, '0')) as nb from e where site_key <> '' and site_key not in (select site_key from p) group by 1)
select o_orderkey, case when e.site_key = '' then 'UNMATCHABLE' when p.pid is not null or f.nb <> '' then 'MATCHED' else 'UNMATCHED' end as match_status,
       case when p.pid is not null then 'normalized-site-address' when f.nb <> '' then 'new-site' end as match_reason, coalesce(p.pid, case when f.nb <> '' then 'site:' || sha256(e.site_key) end) as project_id
from e left join p using (site_key) left join f using (site_key)""")
def site_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matching run: known sites, new ones, and permits that stay without a project."""
    c = F.col
    site = lambda key: F.concat(F.lit("site"), c(key).cast("string"))
    projects = binding.table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.lpad(c("c_custkey").cast("string"), 12, "0").alias("project_id"), site("c_custkey").alias("site_key"), site("c_custkey").alias("address_key"))
    permits = binding.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lpad(c("o_orderkey").cast("string"), 12, "0").alias("event_id"), c("o_orderdate").alias("first_observed_at"), F.when(c("o_orderpriority") == "5-LOW", "").otherwise(site("o_custkey")).alias("site_key"),
        F.lit("").alias("address_key"), F.when(c("o_orderstatus") != "P", F.concat(F.lit("N"), (c("o_custkey") % 25).cast("string"))).alias("neighbourhood_id"),
    )
    return matching.assign_projects(permits, projects)[0].select("o_orderkey", "match_status", "match_reason", "project_id")


@query("permit_dedupe", """
select 'permit:v1:city%20feed:' || o_custkey || '%2F' || o_orderstatus as identity, min(o_orderkey) as o_orderkey, count(*) as n from orders group by o_custkey, o_orderstatus""")
def permit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer and status, by an identity that must be encoded."""
    own = binding.table(spark, sf_dir, "orders").select("o_orderkey", matching.permit_identity(F.lit(" City Feed "), F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderstatus")).alias("identity"))
    counts = own.groupBy("identity").agg(F.count("*").alias("n"))
    return matching.first_wins(own, ["identity"], ["o_orderkey"]).join(counts, "identity").select("identity", "o_orderkey", "n")


@query("document_dedupe", "select min(doc_id) as doc_id, count(*) as n, sha256(text) as checksum from documents group by text")
def document_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-wins dedupe of whole texts by checksum: what is shuffled is a digest, not the text."""
    own = binding.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return own.groupBy("checksum").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("civil_dates", """
select event_id, cast((ts at time zone 'UTC') at time zone 'America/Edmonton' as date) as local_day, datediff('day', cast(ts as date), date '2024-02-15') as days, cast(cast(ts as date) + 548 as date) as typical, cast(ts as date) between date '2024-01-09' and date '2024-01-15' as in_week,
       least(cast(ts as date), date '2024-01-10') as first_day, greatest(cast(ts as date), date '2024-01-10') as last_day from events""")
def civil_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binding.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("d"), F.col("ts").cast("timestamp").alias("t"))
    through = F.to_date(F.lit("2024-01-15"))
    first, last = dates.source_span(F.col("d"), F.lit(None).cast("date"), F.to_date(F.lit("2024-01-10")))
    return own.select("event_id", dates.local_date(F.col("t")).alias("local_day"), F.datediff(F.to_date(F.lit("2024-02-15")), "d").alias("days"), F.date_add("d", 548).alias("typical"), dates.in_range(F.col("d"), dates.window_start(through, 7), through).alias("in_week"), first.alias("first_day"), last.alias("last_day"))


@query("event_dates", """
select o_orderkey, case o_orderstatus when 'F' then cast(o_orderdate as date) when 'O' then cast(o_orderdate as date) - 30 else cast(o_orderdate as date) + 60 end as project_event_date,
       case o_orderstatus when 'F' then cast(o_orderdate as date) when 'O' then cast(o_orderdate as date) - 30 else cast(o_orderdate as date) + 7 end as event_time from orders""")
def event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two fallback chains, which differ where neither issue nor application date is known."""
    d = F.to_date("o_orderdate")
    when = lambda status, date: F.when(F.col("o_orderstatus") == status, date)
    issue, application, occupancy, event = when("F", d), when("O", F.date_sub(d, 30)), when("P", F.date_add(d, 60)), F.date_add(d, 7)
    null = F.lit(None).cast("timestamp")
    return binding.table(spark, sf_dir, "orders").select("o_orderkey", dates.project_event_date(issue, application, occupancy, null, event, null).alias("project_event_date"), dates.event_time(issue, application, event, occupancy).alias("event_time"))


@query("json_path", "select event_type, cast(count(*) filter (where cast(json_extract(props, '$.k') as integer) = 42) as bigint) as hits, cast(sum(cast(json_extract(props, '$.k') as integer)) as bigint) as total from events group by 1")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = text.integer(F.get_json_object("props", "$.k"))
    return binding.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.get_json_object("props", "$.k") == "42").alias("hits"), F.sum(k).alias("total"))


@query("provenance_backfill", """
select event_id, case when event_type = 'view' then 'building' when event_type = 'click' then 'development' when event_type = 'error' then 'building' when event_type = 'signup' then null else 'development' end as dataset from events""")
def provenance_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets by the fields of payloads (null ones too), then by the provider's name."""
    c = F.col
    payload = F.when(c("event_type") == "view", '{"job_category":"x","issue_date":null}').when(c("event_type") == "click", '{"city_file_number":"1","permit_date":"2020-01-01"}').otherwise(F.col("props"))
    provider = F.when(c("event_type") == "error", "city:24uj-dj8v").when(c("event_type") == "purchase", "city:2ccn-pwtu").otherwise("city")
    return binding.table(spark, sf_dir, "events").select("event_id", matching.dataset_provenance(payload, provider).alias("dataset"))


@query("text_signals", """
with t as (select doc_id, ' ' || trim(regexp_replace(lower(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) || ' ' as t from documents)
select doc_id, contains(t, ' the ') or contains(t, ' of the ') as phrase_found, length(t) - 2 as n from t""")
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase tests over whole documents. Accents are dropped with their letters here, as no SQL engine decomposes them the
    same way; ``searchable`` with decomposition is held against its rule by the tests."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    own = text.searchable(plain, ascii_only=True)
    return binding.table(spark, sf_dir, "documents").select("doc_id", text.contains_any(own, ["the", "of  the"]).alias("phrase_found"), F.length(own).cast("long").alias("n"))


@query("searchable_documents")
def searchable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document by the first normaliser, with its accents decomposed."""
    return binding.table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.searchable(F.col("text")), 256).alias("digest"))


@query("labels_semi", "select lang, count(*) as n from documents where doc_id in (select doc_id from labels where quality = 1) group by 1")
def labels_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = binding.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return binding.table(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))
