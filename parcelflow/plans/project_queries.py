"""Assessment, episodes, classification, stages and the actions that change projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import geo
from ..operators import episode, matching, project, timeline
from ..session import dealt
from . import binding
from .catalogue import query


@query("roles", f"""
with {binding.EV_SQL}
select event_id, role, role = 'PRINCIPAL_DEMOLITION' as demolition, role = 'PRINCIPAL_RESIDENTIAL' as new_residential, role in ('PRINCIPAL_DEMOLITION', 'PRINCIPAL_RESIDENTIAL', 'RESIDENTIAL_SUPPORTING') as residential,
       role = 'RESIDENTIAL_SUPPORTING' as renovation, kind = 'new' as new_dwelling, kind = 'shed' as property_only, dataset = 'development' as dev_permit, dataset = 'building' as bldg_permit from ev""")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.assessed(spark, sf_dir).select("event_id", "role", "demolition", "new_residential", "residential", "renovation", "new_dwelling", "property_only", "dev_permit", "bldg_permit")


@query("episodes_orders", f"with {binding.EPISODE_SQL} select event_id, project_id, min(issue_date) over w as episode_start, max(fin) over w as episode_end, row_number() over (partition by project_id order by issue_date, event_id) as position from chosen window w as (partition by project_id)")
def episodes_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode.latest_episode(binding.assessed(spark, sf_dir, by_project=True)).select("event_id", "project_id", "episode_start", "episode_end", F.col("position").cast("long").alias("position"))


@query("episodes_events", """
with o as (select *, max(ts) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from events),
s as (select *, sum(case when before is null or ts > before + interval 24 hour then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as episode from o)
select user_id, cast(episode as bigint) as episode, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from s group by 1, 2""")
def episodes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = episode.sessions(binding.table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "ts", F.expr("interval 24 hours"), ["event_id"])
    return own.groupBy("user_id", "episode").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_HOT = "case when cast(substring(event_id, 12, 1) as int) % 2 = 0 then 'hot' else project_id end"


@query("episodes_hot_key", f"""
with {binding.EPISODE_SQL.replace("as project_id, kind", "as own_project, kind").replace("from (select *, case", "from (select *, 0 as x, case", 1).replace("lpad(cast(o_custkey as varchar), 12, '0') as own_project", "case when o_orderkey % 2 = 0 then 'hot' else lpad(cast(o_custkey as varchar), 12, '0') end as project_id")}
select event_id, project_id, min(issue_date) over w as episode_start, max(fin) over w as episode_end, row_number() over (partition by project_id order by issue_date, event_id) as position from chosen window w as (partition by project_id)""")
def episodes_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all permits belong to one project: its events are cut to slices of time."""
    own = binding.assessed(spark, sf_dir).withColumn("project_id", F.expr(_HOT)).select("event_id", "project_id", "role", "event_date", "source_start", "source_end", "ordering_date")
    return episode.latest_episode(own, slices=episode.SLICES).select("event_id", "project_id", "episode_start", "episode_end", F.col("position").cast("long").alias("position"))


@query("sessions_hot_key", """
with e as (select case when event_id % 2 = 0 then -1 else user_id end as user_id, ts, event_id from events),
o as (select *, max(ts) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from e),
s as (select *, sum(case when before is null or ts > before + interval 5 minute then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as episode from o)
select user_id, cast(episode as bigint) as episode, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from s group by 1, 2""")
def sessions_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all events belong to one user."""
    events = binding.table(spark, sf_dir, "events").select(F.expr("case when event_id % 2 = 0 then -1 else user_id end").alias("user_id"), "ts", "event_id")
    own = episode.sliced_sessions(events, "user_id", "ts", "ts", F.expr("interval 5 minutes"), ["event_id"])
    return own.groupBy("user_id", "episode").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("episode_undated", f"""
with {binding.EV_SQL}, undated as (select project_id from ev group by 1 having not bool_or(st = 'F'))
select event_id, project_id, cast(null as date) as episode_start from ev join undated using (project_id) where role not in ('PROPERTY_ONLY', 'EXCLUDED')""")
def episode_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites none of whose permits is dated keep their undated ones as the episode: dates of sites without an issued
    permit are taken away."""
    own = binding.assessed(spark, sf_dir, by_project=True)
    issued = own.groupBy("project_id").agg(F.bool_or(F.col("status") == "Issued").alias("_issued"))
    blank = own.join(issued.filter("not _issued").select("project_id"), "project_id", "left_semi").withColumns({n: F.lit(None).cast(own.schema[n].dataType) for n in ("source_start", "source_end", "ordering_date", "issue_date", "event_time")})
    return episode.latest_episode(blank).select("event_id", "project_id", "episode_start")


@query("nearest_prior_demolition", """
with d as (
  select p.user_id, date_diff('microsecond', max(e.ts), p.ts) // 86400000000 as days
  from events p join events e on e.user_id = p.user_id and e.event_type = 'error' and e.ts <= p.ts where p.event_type = 'purchase' group by p.user_id, p.event_id, p.ts)
select u.user_id, cast(min(d.days) as bigint) as days from (select distinct user_id from events) u left join d using (user_id) group by 1""")
def nearest_prior_demolition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode.nearest_prior(binding.table(spark, sf_dir, "events").select("user_id", "ts", "event_type"), "user_id", "ts", F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("dev_and_bldg", f"with {binding.EPISODE_SQL} select project_id, bool_or(kind = 'form') and bool_or(kind = 'new') as both from chosen group by 1")
def dev_and_bldg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    own = episode.latest_episode(binding.assessed(spark, sf_dir, by_project=True))
    dev, bldg = c("dev_permit") & c("new_residential"), c("bldg_permit") & c("new_residential")
    return own.groupBy("project_id").agg(((F.count_if(dev) >= 1) & (F.count_if(bldg) >= 1) & (F.count_if(dev | bldg) >= 2)).alias("both"))


@query("classify_score", f"with {binding.GOLD_SQL} select project_id, category, cast(confidence as integer) as confidence, cast(gap as bigint) as gap, infill_start_date, latest_infill_activity_date, cast(units as bigint) as units, value from gold join per using (project_id)")
def classify_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = binding.sites(spark, sf_dir)
    area = own.select("project_id", geo.area_class(F.col("latitude"), F.col("longitude")).alias("area_class"))
    found = project.classify(binding.assessed(spark, sf_dir, by_project=True), area=area, dealt=True)
    return found.select("project_id", "category", "confidence", F.col("demolition_to_construction_days").alias("gap"), "infill_start_date", "latest_infill_activity_date", "units", "value")


#: What the previews ask for: more points for new construction beyond a higher value, and a shorter gap.
_WEIGHTS = {"weights": {"newResidentialConstruction": 45}, "high_value": 400_000}
_PREVIEW_SQL = """
select b.project_id, b.category as category_before, a.category as category_after, b.stage as stage_before, a.stage as stage_after, cast(b.confidence as integer) as confidence_before, cast(a.confidence as integer) as confidence_after
from (with {before} select * from gold join (select project_id from per) using (project_id)) b join (with {after} select * from gold) a using (project_id)
where b.category <> a.category or b.stage <> a.stage or b.confidence <> a.confidence"""


def _preview(spark: SparkSession, sf_dir: str, **change) -> DataFrame:
    own = binding.sites(spark, sf_dir)
    area = own.select("project_id", geo.area_class(F.col("latitude"), F.col("longitude")).alias("area_class"))
    found = project.preview(binding.permits(spark, sf_dir), DEFAULT.override(**change), area=area, ascii_only=True)
    return found.select("project_id", *[F.col(f"{side}.{n}").alias(f"{n}_{side}") for n in ("category", "stage", "confidence") for side in ("before", "after")])


@query("policy_preview", _PREVIEW_SQL.format(before=binding.GOLD_SQL, after=binding.GOLD_SQL.replace("when ep.fresh then 30", "when ep.fresh then 45").replace("ep.value > 250000", "ep.value > 400000")))
def policy_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projects that other points would change: one shuffle of permits for both policies."""
    return _preview(spark, sf_dir, **_WEIGHTS)


@query("policy_preview_gap", _PREVIEW_SQL.format(before=binding.GOLD_SQL, after=binding.GOLD_SQL.replace("548", "200")))
def policy_preview_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projects that a shorter gap between episodes would change: other episodes out of the same signals."""
    return _preview(spark, sf_dir, gap_days=200)


@query("project_states", f"with {binding.GOLD_SQL} select project_id, category, stage, cast(confidence as integer) as confidence, earliest_date, latest_date, latest_occupancy, area_class, requires_market_review from gold")
def project_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.gold(spark, sf_dir).select("project_id", F.col("effective_category").alias("category"), F.col("effective_stage").alias("stage"), "confidence", "earliest_date", "latest_date", "latest_occupancy", "area_class", "requires_market_review")


@query("milestones", f"""
with {binding.EV_SQL},
m as (
  select event_id, case when kind = 'demo' then 'DEMOLITION' when dataset = 'development' then 'DEVELOPMENT_PERMIT' else 'BUILDING_PERMIT' end as milestone, issue_date as milestone_date from ev
  union all select event_id, 'OCCUPANCY', occupancy_date from ev where occupancy_date is not null)
select event_id, milestone, case milestone when 'OCCUPANCY' then 'COMPLETE' else milestone end as stage, milestone_date, case milestone when 'DEMOLITION' then 1 when 'DEVELOPMENT_PERMIT' then 3 when 'BUILDING_PERMIT' then 4 else 7 end as stage_rank from m""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timeline.milestones(binding.assess.complete(binding.permits(spark, sf_dir)))
    return own.select("event_id", "milestone", "stage", "milestone_date", F.col("stage_rank").cast("int").alias("stage_rank"))


@query("timeline_turns", "select conv_id, cast(turn as bigint) as turn, row_number() over (partition by conv_id order by turn, role) as place from conversations")
def timeline_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a project's timeline, over conversations."""
    from pyspark.sql import Window

    own = binding.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    return own.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")).cast("long").alias("place"))


@query("stage_rank", f"""
with {binding.EV_SQL}
select project_id, case when bool_or(occupancy_date is not null) then 'COMPLETE' when bool_and(st = 'P') then 'CANCELLED'
  else case max(case when kind = 'demo' then 1 when dataset = 'development' then 3 else 4 end) when 1 then 'DEMOLITION' when 3 then 'DEVELOPMENT_PERMIT' else 'BUILDING_PERMIT' end end as stage from ev group by 1""")
def stage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.project_stages(binding.assess.complete(binding.permits(spark, sf_dir)))


@query("market_review", f"with {binding.GOLD_SQL} select project_id, requires_market_review and (r is null or r < latest_occupancy) as requires_market_review from gold left join (select project_id, max(issue_date) as r from ev where kind = 'shed' group by 1) using (project_id)")
def market_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest shed's date stands for the last market check."""
    own = binding.gold(spark, sf_dir)
    checked = binding.permits(spark, sf_dir).filter("kind = 'shed'").groupBy("project_id").agg(F.max("issue_date").alias("checked"))
    return own.join(checked, "project_id", "left").select("project_id", project.market_review(F.col("effective_category"), F.col("latest_occupancy"), F.col("checked")).alias("requires_market_review"))


@query("action_log", f"""
with {binding.GOLD_SQL},
log as (select project_id, case st when 'F' then 'CATEGORY' when 'O' then 'STAGE' end as action, case st when 'F' then 'PROBABLE_DUPLEX' else case when value > 250000 then 'CONSTRUCTION' else 'INSPECTION' end end as v, issue_date, event_id from ev where kind = 'shed' and st <> 'P'),
last as (select project_id, max(v) filter (where action = 'CATEGORY') as co, max_by(v, strftime(issue_date, '%Y%m%d') || event_id) filter (where action = 'STAGE') as so from log group by 1)
select project_id, coalesce(co, category) as effective_category, coalesce(so, stage) as effective_stage from gold left join last using (project_id)""")
def action_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheds stand for reviewers' actions: issued ones override the category, approved ones the stage."""
    own = binding.gold(spark, sf_dir).withColumns({"category": F.col("effective_category"), "stage": F.col("effective_stage")}).drop("effective_category", "effective_stage", "category_override", "stage_override", "market_checked", "requires_market_review")
    sheds = dealt(binding.permits(spark, sf_dir, even=False), "project_id").filter("kind = 'shed' and status <> 'Cancelled'")
    issued = F.col("status") == "Issued"
    actions = sheds.select("project_id", F.when(issued, "CATEGORY").otherwise("STAGE").alias("action"), F.when(issued, "PROBABLE_DUPLEX").when(F.col("value") > 250_000, "CONSTRUCTION").otherwise("INSPECTION").alias("value"), F.col("issue_date").alias("at"), F.col("event_id").alias("seq"))
    return project.apply_actions(own, actions).select("project_id", "effective_category", "effective_stage")


@query("merge_flatten", """
with recursive m as (select c_custkey as s, c_custkey - 1 as t from customer where c_mktsegment = 'MACHINERY' and c_custkey > 0),
w as (select s, t from m union all select w.s, m.t from w join m on w.t = m.s)
select cast(s as bigint) as source, cast(min(t) as bigint) as target from w group by 1""")
def merge_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of merges, each into the project before it, followed to their ends."""
    own = binding.table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY' and c_custkey > 0")
    return project.flatten_merges(own.select(F.col("c_custkey").alias("source"), (F.col("c_custkey") - 1).alias("target")))


@query("merge_repoint", """
with recursive m as (select c_custkey as s, c_custkey - 1 as t from customer where c_mktsegment = 'MACHINERY' and c_custkey > 0),
w as (select s, t from m union all select w.s, m.t from w join m on w.t = m.s), flat as (select s, min(t) as t from w group by 1)
select coalesce(t, o_custkey) as project_id, count(*) as n from orders left join flat on s = o_custkey group by 1""")
def merge_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permits of merged projects counted where they went."""
    own = binding.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"))
    return project.repoint(own, merge_flatten(spark, sf_dir)).groupBy("project_id").agg(F.count("*").alias("n"))


@query("point_in_polygon", f"with {binding.SITE_SQL} select project_id, area_class from sites")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.sites(spark, sf_dir).select("project_id", geo.area_class(F.col("latitude"), F.col("longitude")).alias("area_class"))


@query("area_unanimous", f"""
with {binding.SITE_SQL},
linked as (select distinct lpad(cast(a.o_custkey as varchar), 12, '0') as project_id, s.area_class from orders a join sites s on s.project_id = lpad(cast(a.o_orderkey % (select count(*) from customer) as varchar), 12, '0') where s.area_class <> 'UNKNOWN'),
agreed as (select project_id, min(area_class) as c from linked group by 1 having count(*) = 1)
select project_id, case when area_class <> 'UNKNOWN' then area_class else coalesce(c, 'UNKNOWN') end as area_class from sites left join agreed using (project_id)""")
def area_unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project without coordinates takes the class on which its permits' addresses agree (each order stands at the site
    that its key, wrapped around the customers, names)."""
    own = binding.sites(spark, sf_dir)
    customers = binding.table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    orders = binding.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(F.broadcast(customers), F.lit(True))
    at = orders.select(F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("project_id"), F.lpad((F.col("o_orderkey") % F.col("n")).cast("string"), 12, "0").alias("site"))
    linked = at.join(own.select(F.col("project_id").alias("site"), "latitude", "longitude"), "site").select("project_id", "latitude", "longitude")
    return project.project_area(own, linked)


@query("match_queue", f"with {binding.EV_SQL} select count(*) filter (where st = 'O') as pending, count(*) as permits from ev")
def match_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permits that wait to be matched: those approved stand for the pending ones."""
    from ..sources import snapshot

    own = binding.permits(spark, sf_dir).select(F.when(F.col("status") == "Approved", "PENDING").otherwise("MATCHED").alias("match_status"), F.lit(snapshot.NORMALIZATION_VERSION).alias("normalization_version"))
    return snapshot.pending(own).agg(F.count("*").alias("pending")).join(own.agg(F.count("*").alias("permits")), F.lit(True))


@query("group_by_site", """
select o_orderkey, 'edmonton|ab|' || (o_custkey + 1) || ' ' || (o_custkey % 90 + 1) || ' ave nw' as site_key, count(*) over (partition by o_custkey) as n, cast(row_number() over (partition by o_custkey order by o_orderkey) as integer) as place from orders""")
def group_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at the street addresses that their customers' keys spell."""
    from ..functions import address

    own = binding.table(spark, sf_dir, "orders").select("o_orderkey", F.concat((F.col("o_custkey") + 1).cast("string"), F.lit(" "), (F.col("o_custkey") % 90 + 1).cast("string"), F.lit("th Avenue Northwest")).alias("raw"))
    return matching.group_by_site(own.select("o_orderkey", address.site_key(address.street(F.col("raw"))).alias("site_key")), ["o_orderkey"])
