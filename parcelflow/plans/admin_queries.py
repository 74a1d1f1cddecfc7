"""Administration: explanations, the rules page, project details, keyed matching, reassignment and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, matching, project, readmodel
from . import binding, read_queries
from .catalogue import query


@query("explanation_text", f"""
with {binding.GOLD_SQL},
told as (
  select g.project_id, p.shop and ep.n_episode is null as shop, g.category, cast(g.confidence as integer) as confidence, g.area_class, near.gap, ep.n_episode, ep.demo, ep.fresh, ep.semi as two, ep.lang, ep.units, ep.value, ep.reno
  from gold g join per p using (project_id) left join ep using (project_id) left join near using (project_id))
select project_id, concat_ws(' ',
    case category {' '.join(f"when '{k}' then '{v}'" for k, v in project.text.LABELS.items())} end || ' with a confidence score of ' || confidence || '/100.',
    case when shop then 'Commercial or industrial language excludes the project.' else nullif(concat_ws(' ',
      case when demo and (not fresh or gap <= 548) then 'A demolition was found at the site.' end, case when fresh then 'New residential construction was found.' end,
      case when two and lang then 'There are a development and a building permit.' end, case when lang then 'The work is described as a new dwelling.' end,
      case when units >= 2 then 'Units added: ' || units || '.' end, case when n_episode > 0 then 'The building type is residential.' end,
      case when value > 250000 then 'The construction value exceeds 250,000.' end, case when reno and not fresh then 'Only renovation is described.' end,
      case when area_class = 'OUTSIDE_CORE' then 'The site is outside the core area.' end), '') end,
    case when gap <= 548 then 'Demolition preceded construction by ' || gap || ' days.' end) as explanation
from told""")
def explanation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binding.gold(spark, sf_dir).filter(F.col("explanation").isNotNull())
    return own.select("project_id", F.regexp_replace("explanation", " +", " ").alias("explanation"))


@query("explanation_parse", """
with e as (
  select p_partkey, p_size % 8 as form, p_size from part)
select p_partkey, form in (0, 1, 5) as available, case when form = 0 then 'S' || p_size when form = 1 then 'T' when form = 5 then 'U' else 'There is no explanation for this score.' end as summary,
       case when form = 0 then p_size else 33 end as score, case when form = 1 then 1 else 0 end as n_factors, case when form = 5 then p_size end as days
from e""")
def explanation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON, sound in three forms and broken in five: a blank summary, a score out of bounds, a factor without a
    rule, text that is no JSON, and null."""
    size = F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit('{"summary":" S'), size, F.lit(' ","score":'), size, F.lit("}")), F.lit('{"summary":"T","factors":[{"rule":"r","points":-5}],"more":1}'), F.lit('{"summary":"  "}'), F.lit('{"summary":"x","score":101}'),
        F.lit('{"summary":"x","factors":[{"points":5}]}'), F.concat(F.lit('{"summary":"U","timeline":{"demolitionToConstructionDays":'), size, F.lit("}}")), F.lit("no JSON"), F.lit(None).cast("string"),
    ]
    own = binding.table(spark, sf_dir, "part").withColumn("json", F.get(F.array(*forms), F.col("p_size") % 8))
    own = own.withColumn("e", readmodel.explanation(F.col("json"), F.lit(33)))
    return own.select("p_partkey", "e.available", "e.summary", "e.score", F.size("e.factors").alias("n_factors"), F.col("e.timeline.days").cast("int").alias("days"))


@query("rules_list", f"""
with {binding.GOLD_SQL}
select project_id, review_status, cast(confidence as integer) as confidence from gold where merged_into is null
order by case review_status when 'PENDING' then 1 when 'CONFIRMED' then 2 else 3 end, confidence, latest_infill_activity_date desc nulls last, project_id limit 100""")
def rules_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.rules_list(binding.gold(spark, sf_dir)).select("project_id", "review_status", "confidence")


WANTED = [f"{i:012d}" for i in range(1, 61)]
_IDS = ", ".join(f"'{i}'" for i in WANTED)


@query("project_detail", f"""
with {binding.GOLD_SQL},
m as (
  select project_id, event_id, case when kind = 'demo' then 'DEMOLITION' when dataset = 'development' then 'DEVELOPMENT_PERMIT' else 'BUILDING_PERMIT' end as milestone, issue_date as milestone_date, case when kind = 'demo' then 1 when dataset = 'development' then 3 else 4 end as rank from ev
  union all select project_id, event_id, 'OCCUPANCY', occupancy_date, 7 from ev where occupancy_date is not null)
select project_id, title, category, cast(confidence as integer) as confidence, event_id, milestone, milestone_date, cast(case when event_id is not null then row_number() over (partition by project_id order by milestone_date, rank, event_id, milestone) end as integer) as place
from gold left join m using (project_id) where project_id in ({_IDS})""")
def project_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty projects with the timelines of all their permits."""
    own = readmodel.detail(binding.gold(spark, sf_dir), binding.permits(spark, sf_dir), WANTED)
    return own.select("project_id", "title", "category", "confidence", "event_id", "milestone", "milestone_date", "place")


@query("match_keys", """
with p as (
  select c_custkey as id, 's' || (c_custkey % 400) as site, 'a' || (c_custkey % 900) as addr, case when c_custkey % 3 = 0 then 't' || c_custkey end as made, case when c_custkey % 5 = 0 and c_custkey > 1 then c_custkey - 1 end as into_ from customer),
q as (select o_orderkey, case when o_orderkey % 2 = 0 then 's' || (o_custkey % 500) else 't' || o_custkey end as site, 'a' || (o_orderkey % 900) as addr from orders),
live as (select * from p where into_ is null),
any_ as (select site, min(id) as id from live group by 1), exact as (select site, addr, min(id) as id from live group by 1, 2)
select o_orderkey, coalesce(e.id, a.id, k.into_, k.id) as project_id, case when coalesce(e.id, a.id) is not null then 'site' when k.id is not null then 'key' end as match_by,
       coalesce(e.id, a.id) is not null or k.into_ is null or h.into_ is null as valid
from q left join exact e using (site, addr) left join any_ a using (site) left join p k on k.made = q.site left join p h on h.id = k.into_""")
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to customers by site, by the key of a former run, and over one merge."""
    c, text_ = F.col, lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    own = binding.table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("project_id"), text_("s", c("c_custkey") % 400).alias("site_key"), text_("a", c("c_custkey") % 900).alias("address_id"),
        F.when(c("c_custkey") % 3 == 0, matching.project_key(text_("t", c("c_custkey")))).alias("project_key"), F.when((c("c_custkey") % 5 == 0) & (c("c_custkey") > 1), c("c_custkey") - 1).alias("merged_into"),
    )
    even = c("o_orderkey") % 2 == 0
    permits = binding.table(spark, sf_dir, "orders").select("o_orderkey", F.when(even, text_("s", c("o_custkey") % 500)).otherwise(text_("t", c("o_custkey"))).alias("site_key"), text_("a", c("o_orderkey") % 900).alias("address_id"))
    return matching.match_keys(permits, own).select("o_orderkey", "project_id", "match_by", "valid")


@query("job_result", """
with m as (select o_orderkey as id, case when o_orderstatus = 'P' then case when o_totalprice > 200000 then 'UNMATCHABLE' else 'UNMATCHED' end else 'MATCHED' end as s from orders)
select count(*) as processed, count(*) filter (where s = 'MATCHED') as matched, count(*) filter (where s <> 'MATCHED') as failed,
       (select string_agg(id || ':' || s, ',' order by id) from (select * from m where s <> 'MATCHED' order by id limit 10)) as failures from m""")
def job_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "P", "MATCHED").when(F.col("o_totalprice") > 200_000, "UNMATCHABLE").otherwise("UNMATCHED")
    own = matching.job_result(binding.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), status.alias("match_status")))
    return own.withColumn("failures", F.array_join(F.transform("failures", lambda f: F.concat_ws(":", f["event_id"].cast("string"), f["reason"])), ","))


@query("reassigned", """
with a as (select l_orderkey as event_id, l_suppkey as after, l_linenumber as seq, l_shipdate as d from lineitem where l_returnflag = 'R'),
last as (select event_id, arg_max(after, strftime(d, '%Y%m%d') || lpad(cast(seq as varchar), 4, '0') || lpad(cast(after as varchar), 9, '0')) as after from a group by 1)
select coalesce(l.after, o_custkey) as project_id, count(*) as n, count(l.after) as moved from orders left join last l on l.event_id = o_orderkey group by 1""")
def reassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items stand for reviewers' moves of an order to a supplier; the latest of an order counts."""
    moved, _ = project.reassign(*_moves(spark, sf_dir))
    return moved.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(F.col("match_reason") == "manual").alias("moved"))


@query("reassign_audit", """
with a as (select l_orderkey as event_id, l_suppkey as after, l_linenumber as seq, l_shipdate as d from lineitem where l_returnflag = 'R')
select event_id, cast(seq as bigint) as seq, coalesce(lag(after) over (partition by event_id order by d, seq, after), o_custkey) as before, after from a join orders on o_orderkey = event_id""")
def reassign_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = project.reassign(*_moves(spark, sf_dir))
    return rows.select("event_id", F.col("seq").cast("long").alias("seq"), "before", "after")


def _moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    events = binding.table(spark, sf_dir, "orders").select(c("o_orderkey").alias("event_id"), c("o_custkey").alias("project_id"))
    moves = binding.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(c("l_orderkey").alias("event_id"), c("l_suppkey").alias("project_id"), c("l_shipdate").alias("at"), c("l_linenumber").alias("seq"))
    return events, moves


@query("action_audit", """
with a as (
  select event_id, user_id, ts, event_type, case event_type when 'click' then 'STAGE' when 'view' then 'CATEGORY' when 'purchase' then 'NOT_RELEVANT' end as action, 'v' || (event_id % 7) as v from events),
b as (select user_id as project_id, event_id as seq, case action when 'STAGE' then 'stage' else 'category' end as field, case action when 'NOT_RELEVANT' then 'NOT_RELEVANT' else v end as after, ts from a where action is not null)
select project_id, seq, field, coalesce(lag(after) over (partition by project_id, field order by ts, seq, after), case when field = 'stage' then 'DISCOVERED' else 'PROBABLE_DUPLEX' end) as before, after from b""")
def action_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of a user's events stand for a reviewer's actions on a project, others for unknown ones."""
    c = F.col
    own = binding.table(spark, sf_dir, "events")
    kind = F.when(c("event_type") == "click", "STAGE").when(c("event_type") == "view", "CATEGORY").when(c("event_type") == "purchase", "NOT_RELEVANT").otherwise("LOOK")
    actions = own.select(c("user_id").alias("project_id"), kind.alias("action"), F.concat(F.lit("v"), (c("event_id") % 7).cast("string")).alias("value"), c("ts").alias("at"), c("event_id").alias("seq"))
    projects = own.select(c("user_id").alias("project_id")).distinct().select("project_id", F.lit("PROBABLE_DUPLEX").alias("category"), F.lit("DISCOVERED").alias("stage"))
    return project.audit(actions, projects).select("project_id", "seq", "field", "before", "after")


@query("saved_search_matches", f"""
with {binding.GOLD_SQL}, {read_queries._LAST_SQL}, p as (select g.*, l.status from gold g left join last_ev l using (project_id))
select 1 as search_id, project_id from p where neighbourhood_id in ('N1', 'N2') and confidence >= 20
union all select 2, project_id from p where category = 'PROBABLE_SEMI_DETACHED_INFILL' and status = 'Issued' and value between 100000 and 400000
union all select 4, project_id from p where stage = 'COMPLETE' and units >= 2 and confidence >= 50
union all select 5, project_id from p where status = 'Cancelled' and units <= 1""")
def saved_search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All projects against the searches, by equality of selections and ranges in the join."""
    searches = spark.createDataFrame(read_queries.SEARCHES, read_queries._SEARCH_SCHEMA)
    return alerts.matching(read_queries._search_projects(spark, sf_dir), searches).select("search_id", "project_id")
