"""Driver tables as the domain's tables: orders are permits, customers their sites, nations neighbourhoods.

Spark frames and the SQL that the checks use say the same in two ways: the SQL takes each kind of permit's role and
signals from a table written by hand, the frames find them in its texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import assess, project
from ..session import dealt, spread

#: kind: dataset, type, subtype, description, building type
TEXTS = {
    "new": ("building", "Single Detached House", "(01) New", "To construct a new single detached house", "Single Detached House"),
    "demo": ("building", "Demolition", None, "Demolition of existing single detached house", None),
    "form": ("development", "Development Permit", "Class A", "To construct a Residential Use building in the form of a semi-detached house", None),
    "reno": ("building", "Home Improvement Permit", "(03) Interior Alteration", "Interior alteration to develop a basement", "Single Detached House"),
    "shop": ("building", "Commercial Final", "(03) Interior Alteration", "Interior alteration to a retail store", "Retail"),
    "shed": ("building", "Accessory Building", "(01) New", "Detached garage with a deck", None),
}
STATUS = {"P": "Cancelled", "F": "Issued", "O": "Approved"}
KIND = "case substring(o_orderpriority, 1, 1) when '1' then 'new' when '2' then 'demo' when '3' then 'form' when '4' then case when o_totalprice >= 450000 then 'shop' else 'reno' end else 'shed' end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def permits(spark: SparkSession, sf_dir: str, even: bool = True) -> DataFrame:
    """Silver permits out of orders: a scan and a projection; ``even``: texts are read in as many tasks as there are cores,
    which is of no use before a shuffle by project."""
    c = F.col
    own = table(spark, sf_dir, "orders")
    own = (spread(own) if even else own).withColumn("kind", F.expr(KIND))
    texts = F.create_map(*[x for k, v in TEXTS.items() for x in (F.lit(k), F.struct(*[F.lit(t).cast("string").alias(n) for t, n in zip(v, ("dataset", "permit_type", "permit_subtype", "description", "building_type"))]))])
    states = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    issue = F.to_date("o_orderdate")
    built = (c("kind") == "new") & (c("o_orderstatus") == "F")
    own = own.withColumn("t", F.element_at(texts, c("kind")))
    return own.select(
        F.lpad(c("o_orderkey").cast("string"), 12, "0").alias("event_id"), F.lpad(c("o_custkey").cast("string"), 12, "0").alias("project_id"), "t.*",
        F.element_at(states, c("o_orderstatus")).alias("status"), F.when(c("kind") == "new", F.when(c("o_totalprice") > 300_000, 2).otherwise(1)).cast("long").alias("units"),
        c("o_totalprice").alias("value"), issue.alias("issue_date"), F.when(built, F.date_add(issue, (F.lit(150) + F.floor(c("o_totalprice") / 1000)).cast("int"))).alias("occupancy_date"),
        F.concat(F.lit("P-"), c("o_orderkey").cast("string")).alias("permit_number"), issue.alias("project_event_date"), "kind",
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects' own columns out of customers."""
    c = F.col
    near = lambda base, factor, span: F.when(c("c_acctbal") >= 0, F.lit(base) + ((c("c_custkey") * factor) % span).cast("double") / F.lit(1000.0))
    key = F.lpad(c("c_custkey").cast("string"), 12, "0")
    own = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), c("c_nationkey") == c("n_nationkey"))  # nations are a fixed list
    return own.select(
        key.alias("project_id"), F.concat(F.lit("Project "), c("c_name")).alias("title"), F.concat_ws(" ", c("c_custkey").cast("string"), (c("c_nationkey") + 1).cast("string"), F.lit("AVE NW")).alias("street"), key.alias("address_id"),
        near(53.3, 37, 500).alias("latitude"), near(-113.8, 91, 600).alias("longitude"), F.concat(F.lit("N"), c("c_nationkey").cast("string")).alias("neighbourhood_id"), c("n_name").alias("neighbourhood_name"),
        F.when(c("c_mktsegment") == "BUILDING", "CONFIRMED").when(c("c_mktsegment") == "FURNITURE", "CORRECTED").otherwise("PENDING").alias("review_status"),
        F.when((c("c_mktsegment") == "MACHINERY") & (c("c_acctbal") > 9000), F.lit("0" * 12)).alias("merged_into"),
    )


def assessed(spark: SparkSession, sf_dir: str, by_project: bool = False) -> DataFrame:
    """Permits with their signals; ``by_project``: dealt for windows by project, before the signals, as raw columns are smaller."""
    own = permits(spark, sf_dir, even=not by_project)
    return assess.signals(dealt(own, "project_id") if by_project else own, ascii_only=True)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold projects: what the permits say of each site, joined to it."""
    own = sites(spark, sf_dir).withColumn("area_class", geo.area_class(F.col("latitude"), F.col("longitude")))
    states = project.states(permits(spark, sf_dir, even=False), area=own.select("project_id", "area_class"), ascii_only=True)
    return own.join(states.drop("area_class"), "project_id", "left").withColumns({
        "effective_category": F.coalesce("effective_category", F.lit("NOT_RELEVANT")), "effective_stage": F.coalesce("effective_stage", F.lit("DISCOVERED")),
        "confidence": F.coalesce("confidence", F.lit(0)), "requires_market_review": F.coalesce("requires_market_review", F.lit(False)),
    })


# ------------------------------------------------------------------ for checks

EV_SQL = f"""
ev as (
  select lpad(cast(o_orderkey as varchar), 12, '0') as event_id, lpad(cast(o_custkey as varchar), 12, '0') as project_id, kind, o_orderstatus as st, o_totalprice as value,
         cast(o_orderdate as date) as issue_date, 'P-' || o_orderkey as permit_number,
         case when kind = 'form' then 'development' else 'building' end as dataset,
         case when kind = 'new' and o_orderstatus = 'F' then cast(o_orderdate as date) + cast(150 + floor(o_totalprice / 1000) as integer) end as occupancy_date,
         case when kind = 'new' then case when o_totalprice > 300000 then 2 else 1 end end as units,
         case when kind = 'shed' then 'PROPERTY_ONLY' when o_orderstatus = 'P' or kind = 'shop' then 'EXCLUDED' when kind = 'demo' then 'PRINCIPAL_DEMOLITION'
              when kind in ('new', 'form') then 'PRINCIPAL_RESIDENTIAL' else 'RESIDENTIAL_SUPPORTING' end as role
  from (select *, {KIND.replace("substring(o_orderpriority, 1, 1)", "left(o_orderpriority, 1)")} as kind from orders))"""

EPISODE_SQL = EV_SQL + """,
e1 as (select *, coalesce(occupancy_date, issue_date) as fin from ev where role not in ('PROPERTY_ONLY', 'EXCLUDED')),
e2 as (select *, max(fin) over (partition by project_id order by issue_date, event_id rows between unbounded preceding and 1 preceding) as before from e1),
e3 as (select *, sum(case when before is null or issue_date > before + 548 then 1 else 0 end) over (partition by project_id order by issue_date, event_id rows unbounded preceding) as ep from e2),
e4 as (select *, max(ep) over (partition by project_id) as last_ep from e3),
e5 as (select *, max(fin) over (partition by project_id) as ep_end from e4 where ep = last_ep),
chosen as (select * from e5 where fin >= ep_end - 548)"""


def _ring_sql() -> str:
    points = geo.ring()
    return ", ".join(f"({a[0]!r}::double, {a[1]!r}::double, {b[0]!r}::double, {b[1]!r}::double)" for a, b in zip(points, points[1:] + points[:1]))


SITE_SQL = f"""
edges(ax, ay, bx, by_) as (values {_ring_sql()}),
sites0 as (
  select lpad(cast(c_custkey as varchar), 12, '0') as project_id, 'Project ' || c_name as title, c_custkey || ' ' || (c_nationkey + 1) || ' AVE NW' as street,
         case when c_acctbal >= 0 then 53.3::double + cast((c_custkey * 37) % 500 as double) / 1000.0::double end as latitude,
         case when c_acctbal >= 0 then (-113.8)::double + cast((c_custkey * 91) % 600 as double) / 1000.0::double end as longitude,
         'N' || c_nationkey as neighbourhood_id, n_name as neighbourhood_name,
         case c_mktsegment when 'BUILDING' then 'CONFIRMED' when 'FURNITURE' then 'CORRECTED' else 'PENDING' end as review_status,
         case when c_mktsegment = 'MACHINERY' and c_acctbal > 9000 then '000000000000' end as merged_into
  from customer join nation on c_nationkey = n_nationkey),
crossings as (
  select project_id, count(*) filter (where (ay > latitude) <> (by_ > latitude) and longitude < (bx - ax) * (latitude - ay) / (by_ - ay) + ax) % 2 = 1 as inside
  from sites0, edges group by project_id),
sites as (
  select s.*, case when latitude is null or not latitude between 53.3 and 53.8 or not longitude between -113.8 and -113.2 then 'UNKNOWN' when inside then 'CORE' else 'OUTSIDE_CORE' end as area_class
  from sites0 s join crossings using (project_id))"""

GOLD_SQL = EPISODE_SQL + "," + SITE_SQL + """,
near as (
  select n.project_id, min(n.issue_date - d.issue_date) as gap
  from chosen n join chosen d on n.project_id = d.project_id and n.kind in ('new', 'form') and d.kind = 'demo' and d.issue_date <= n.issue_date group by 1),
ep as (
  select project_id, count(*) as n_episode, bool_or(kind = 'demo') as demo, bool_or(kind in ('new', 'form')) as fresh, bool_or(kind = 'form') as semi, bool_or(kind = 'new') as lang, bool_or(kind = 'reno') as reno,
         max(units) as units, max(value) as value, min(issue_date) as infill_start_date, max(fin) as latest_infill_activity_date, bool_or(occupancy_date is not null) as occupied,
         max(case kind when 'demo' then 1 when 'form' then 3 else 4 end) as rank
  from chosen group by 1),
per as (select project_id, count(*) as n_events, bool_or(kind = 'shop') as shop, max(occupancy_date) as latest_occupancy, min(issue_date) as earliest_date, max(coalesce(occupancy_date, issue_date)) as latest_date from ev group by 1),
gold0 as (
  select s.*, p.n_events, p.latest_occupancy, p.earliest_date, p.latest_date, ep.units, ep.value, ep.infill_start_date, ep.latest_infill_activity_date, near.gap,
         case when p.project_id is null then 'NOT_RELEVANT' when ep.n_episode is null then 'NOT_RELEVANT' when ep.fresh then case when ep.semi then 'PROBABLE_SEMI_DETACHED_INFILL' else 'PROBABLE_NEW_DETACHED_INFILL' end
              when ep.demo then 'DEMOLITION_ONLY' when ep.reno then 'RENOVATION_OR_ADDITION' else 'NOT_RELEVANT' end as category,
         case when ep.n_episode is null then 'DISCOVERED' when ep.occupied then 'COMPLETE' when ep.rank = 4 then 'BUILDING_PERMIT' when ep.rank = 3 then 'DEVELOPMENT_PERMIT' else 'DEMOLITION' end as stage,
         case when p.project_id is null or (ep.n_episode is null and p.shop) then 0 else greatest(0, least(100,
           case when ep.demo and (not ep.fresh or near.gap <= 548) then 20 else 0 end + case when ep.fresh then 30 else 0 end + case when ep.semi and ep.lang then 15 else 0 end
           + case when ep.lang then 10 else 0 end + case when ep.units >= 2 then 10 else 0 end + case when ep.n_episode > 0 then 10 else 0 end + case when ep.value > 250000 then 5 else 0 end
           - case when ep.reno and not ep.fresh then 25 else 0 end - case when s.area_class = 'OUTSIDE_CORE' then 40 else 0 end)) end as confidence
  from sites s left join per p using (project_id) left join ep using (project_id) left join near using (project_id)),
gold as (
  select *, latest_occupancy is not null and category in ('PROBABLE_NEW_DETACHED_INFILL', 'PROBABLE_SEMI_DETACHED_INFILL') as requires_market_review from gold0),
public as (select * from gold where merged_into is null and category <> 'NOT_RELEVANT')"""
