"""Time to occupancy over orders and their line items: an item is open while it is neither shipped nor returned."""

from __future__ import annotations

from dataclasses import asdict
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import dates
from ..operators import survival
from ..session import shared_path
from . import binding
from .catalogue import query

AS_OF = "2001-12-01"
FLAGSHIP_DAYS = 1825

OBS_SQL = """
obs0 as (
  select {extra} datediff('day', cast(o_orderdate as date), date '2001-12-01') as elapsed, datediff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as lasted,
         l_linestatus = 'O' and l_returnflag = 'N' as open, cast(l_shipdate as date) > date '2001-12-01' as late
  from orders join lineitem on o_orderkey = l_orderkey {joins}),
obs as (
  select *, not open and lasted <= {days} as occupied, least(case when open then elapsed else lasted end, {days}) as days
  from obs0 where elapsed >= 0 and (open or (not late and lasted > 0)))"""
CURVE_SQL = """
day as (select scope, days, count(*) filter (where occupied) as ev, count(*) filter (where not occupied) as ce from {source} group by 1, 2),
risk as (select *, sum(ev + ce) over (partition by scope order by days desc rows unbounded preceding) as at_risk from day),
surv as (select *, product(1 - ev / cast(at_risk as double)) over (partition by scope order by days rows unbounded preceding) as s from risk),
bench as (
  select scope, cast(sum(ev + ce) as bigint) as cohort_size, cast(sum(ev) as bigint) as occupancy_count, cast(sum(ce) as bigint) as censored_permits,
         cast(min(days) filter (where ev > 0 and s <= 0.75) as integer) as p25_days, cast(min(days) filter (where ev > 0 and s <= 0.5) as integer) as median_days,
         cast(min(days) filter (where ev > 0 and s <= 0.25) as integer) as p75_days
  from surv group by 1)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with issue and occupancy dates: one join, on columns that the scans prune."""
    orders = binding.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("issue_date"))
    lines = binding.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.when(~((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")), F.to_date("l_shipdate")).alias("occupancy_date"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


def observed(spark: SparkSession, sf_dir: str, days: int = FLAGSHIP_DAYS) -> DataFrame:
    return survival.observations(items(spark, sf_dir), F.to_date(F.lit(AS_OF)), max_days=days)


@query("km_portfolio", f"with {OBS_SQL.format(extra='', joins='', days=FLAGSHIP_DAYS)}, scoped as (select 'PORTFOLIO' as scope, * from obs), {CURVE_SQL.format(source='scoped')} select *, cohort_size >= 50 and occupancy_count >= 30 as adequate from bench")
def km_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.benchmarks(observed(spark, sf_dir).withColumn("scope", F.lit(survival.PORTFOLIO)), ["scope"])


@query("km_default_window", f"with {OBS_SQL.format(extra='', joins='', days=survival.MAX_DAYS)}, scoped as (select 'PORTFOLIO' as scope, * from obs), {CURVE_SQL.format(source='scoped')} select *, cohort_size >= 50 and occupancy_count >= 30 as adequate from bench")
def km_default_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the default comparison window the median is not reached."""
    return survival.benchmarks(observed(spark, sf_dir, survival.MAX_DAYS).withColumn("scope", F.lit(survival.PORTFOLIO)), ["scope"])


@query("km_curve", f"with {OBS_SQL.format(extra='', joins='', days=FLAGSHIP_DAYS)}, scoped as (select 'PORTFOLIO' as scope, * from obs), {CURVE_SQL.format(source='scoped')} select cast(days as integer) as days, cast(ev as bigint) as events, cast(ce as bigint) as censored, cast(at_risk as bigint) as at_risk, round(s, 9) as survival from surv")
def km_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = survival.curve(observed(spark, sf_dir).withColumn("scope", F.lit(survival.PORTFOLIO)), ["scope"])
    return own.select("days", "events", "censored", "at_risk", F.round("survival", 9).alias("survival"))


_PARTS = "join part on l_partkey = p_partkey"


def _with_part(own: DataFrame, spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return own.join(binding.table(spark, sf_dir, "part").select("p_partkey", column), F.col("l_partkey") == F.col("p_partkey"))


@query("km_by_category", f"with {OBS_SQL.format(extra='p_type,', joins=_PARTS, days=FLAGSHIP_DAYS)}, scoped as (select unnest(['PORTFOLIO', p_type]) as scope, * from obs), {CURVE_SQL.format(source='scoped')} select *, cohort_size >= 50 and occupancy_count >= 30 as adequate from bench")
def km_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.benchmark_set(_with_part(observed(spark, sf_dir), spark, sf_dir, "p_type"), "p_type")


#: A cohort so large that only some of the groups reach it.
_COHORT = 285


def _fine(own: DataFrame) -> DataFrame:
    return own.withColumn("grp", F.concat_ws("/", "p_brand", "o_orderpriority"))


@query("km_fallback", f"""
with {OBS_SQL.format(extra="p_brand || '/' || o_orderpriority as grp,", joins=_PARTS, days=FLAGSHIP_DAYS)},
scoped as (select unnest(['PORTFOLIO', grp]) as scope, * from obs), {CURVE_SQL.format(source='scoped')},
good as (select * from bench where cohort_size >= {_COHORT} and occupancy_count >= 30 and median_days is not null),
grps as (select distinct p_brand || '/' || o_orderpriority as grp from part, (select distinct o_orderpriority from orders))
select grp, coalesce(g.scope, p.scope, 'BASELINE') as scope, coalesce(g.cohort_size, p.cohort_size, 0) as cohort_size, coalesce(g.occupancy_count, p.occupancy_count, 0) as occupancy_count,
       case when g.scope is not null then g.p25_days else p.p25_days end as p25_days, coalesce(g.median_days, p.median_days, 548) as median_days, case when g.scope is not null then g.p75_days else p.p75_days end as p75_days
from grps left join good g on g.scope = grp left join good p on p.scope = 'PORTFOLIO'""")  # fmt: skip
def km_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _fine(_with_part(observed(spark, sf_dir), spark, sf_dir, "p_brand"))
    brands, priorities = binding.table(spark, sf_dir, "part").select("p_brand").distinct(), binding.table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    groups = _fine(brands.join(F.broadcast(priorities), F.lit(True))).select("grp")  # names of brands by five priorities
    return survival.with_fallback(groups, "grp", survival.benchmark_set(own, "grp", min_cohort=_COHORT))


_GROUP_SQL = f"""{binding.GOLD_SQL},
grouped as (select e.event_id, e.issue_date, e.occupancy_date, case g.category when 'PROBABLE_NEW_DETACHED_INFILL' then 'DETACHED' else g.category end as grp
  from ev e join gold g using (project_id)
  where e.dataset = 'building' and e.role = 'PRINCIPAL_RESIDENTIAL' and g.merged_into is null and g.area_class = 'CORE' and g.category in ('PROBABLE_NEW_DETACHED_INFILL', 'PROBABLE_SEMI_DETACHED_INFILL')),
kobs as (
  select *, occupancy_date is not null and occupancy_date - issue_date <= 730 as occupied, least(case when occupancy_date is null then date '2001-12-01' - issue_date else occupancy_date - issue_date end, 730) as days
  from grouped where issue_date <= date '2001-12-01' and (occupancy_date is null or (occupancy_date <= date '2001-12-01' and occupancy_date > issue_date))),
scoped as (select unnest(['PORTFOLIO', grp]) as scope, days, occupied from kobs), {CURVE_SQL.format(source="scoped")},
good as (select * from bench where cohort_size >= 50 and occupancy_count >= 30 and median_days is not null)"""


def _occupancy_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal residential building permits of core projects with a benchmark category, and the group of each."""
    live = F.col("merged_into").isNull() & (F.col("area_class") == "CORE")
    projects = binding.gold(spark, sf_dir).filter(live).select("project_id", survival.group_of(F.col("effective_category")).alias("grp")).filter("grp is not null")
    own = binding.assessed(spark, sf_dir).filter((F.col("dataset") == "building") & (F.col("role") == "PRINCIPAL_RESIDENTIAL"))
    return own.select("event_id", "project_id", "issue_date", "occupancy_date").join(projects, "project_id")


@query("occupancy_benchmarks", f"with {_GROUP_SQL} select *, cohort_size >= 50 and occupancy_count >= 30 as adequate from bench")
def occupancy_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.benchmark_set(survival.observations(_occupancy_permits(spark, sf_dir), F.to_date(F.lit(AS_OF))), "grp")


@query("benchmark_store", f"with {_GROUP_SQL} select *, cohort_size >= 50 and occupancy_count >= 30 as adequate from bench")
def benchmark_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmarks as a later session finds them in the shared folder, without a look at the permits."""
    store, day = survival.BenchmarkStore(spark, shared_path(spark, "benchmarks")), date.fromisoformat(AS_OF)
    policy = {"max_days": survival.MAX_DAYS, "min_cohort": survival.MIN_COHORT, "min_events": survival.MIN_EVENTS} | asdict(DEFAULT)
    store.get(day, policy, lambda: occupancy_benchmarks(spark, sf_dir))

    def made_already() -> DataFrame:
        raise LookupError("no benchmarks in the shared folder")

    return survival.BenchmarkStore(spark, store.root).get(day, policy, made_already)


@query("timing_estimate", f"""
with {_GROUP_SQL},
chosen_b as (
  select k.event_id, k.issue_date, coalesce(g.scope, p.scope, 'BASELINE') as scope, coalesce(g.median_days, p.median_days, 548) as m, date '2001-12-01' - k.issue_date as e
  from grouped k left join good g on g.scope = k.grp left join good p on p.scope = 'PORTFOLIO' where k.occupancy_date is null)
select event_id, scope, cast(m as integer) as median_days, cast(e as integer) as elapsed_days, cast(least(e, 730) as integer) as comparison_elapsed_days, cast(issue_date + cast(m as integer) as date) as typical_date,
       cast(greatest(0, m - e) as integer) as days_remaining, cast(greatest(0, e - m) as integer) as days_beyond_typical, cast(e - m as integer) as days_from_typical,
       round(least(e, 730) / 730.0::double, 9) as progress, e > 730 as beyond_window, case when scope = 'BASELINE' then 'PLANNING_BASELINE' else 'HISTORICAL_KAPLAN_MEIER' end as basis
from chosen_b where e >= 0""")  # fmt: skip
def timing_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.to_date(F.lit(AS_OF))
    permits = _occupancy_permits(spark, sf_dir)
    own = survival.with_fallback(permits.filter(F.col("occupancy_date").isNull()), "grp", survival.benchmark_set(survival.observations(permits, as_of), "grp"))
    out = survival.timing(own, as_of)
    return out.select("event_id", "scope", "median_days", "elapsed_days", "comparison_elapsed_days", "typical_date", "days_remaining", "days_beyond_typical", "days_from_typical", F.round("progress", 9).alias("progress"), "beyond_window", "basis")


@query("pending_anchor", f"""
with {binding.EV_SQL},
free as (select project_id from ev group by 1 having not bool_or(occupancy_date is not null)),
ranked as (select *, row_number() over (partition by project_id order by issue_date, event_id) as n from ev join free using (project_id) where dataset = 'building' and role = 'PRINCIPAL_RESIDENTIAL' and issue_date <= date '2001-12-01')
select project_id, event_id, issue_date from ranked where n = 1""")  # fmt: skip
def pending_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.pending_anchors(binding.assessed(spark, sf_dir), F.to_date(F.lit(AS_OF)))


@query("cohort_start", "select cast(o_orderdate as date) as d, greatest(case when month(o_orderdate) = 2 and day(o_orderdate) = 29 then make_date(year(o_orderdate) + 23, 3, 1) else cast(cast(o_orderdate as date) + interval 23 year as date) end, date '2022-01-01') as cohort_start, count(*) as n from orders group by all")
def cohort_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort starts of as-of dates twenty-eight years after the orders'."""
    own = binding.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    as_of = F.add_months("d", 336)
    return own.groupBy("d").agg(F.count("*").alias("n")).select("d", dates.cohort_start(as_of).alias("cohort_start"), "n")
