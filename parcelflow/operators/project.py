"""Projects: category, score with its explanation, area, overrides, merges and review flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..functions import geo, text
from ..session import checkpointed, dealt as dealt_by
from . import assess, episode, timeline

#: Forms of new buildings, in order of precedence.
FORMS = ["gardenSuite", "rowHousing", "semiDetached", "duplex", "detached"]
MARKET_REVIEW = [
    "PROBABLE_NEW_DETACHED_INFILL", "PROBABLE_NEW_DETACHED_INFILL_FOR_RESALE", "PROBABLE_SEMI_DETACHED_INFILL", "PROBABLE_DUPLEX", "PROBABLE_ROW_HOUSING", "PROBABLE_GARDEN_SUITE",
]


def classify(assessed: DataFrame, config: ScoringConfig = DEFAULT, area: DataFrame | None = None, market: DataFrame | None = None, more: list[Column] = (), dealt: bool = False) -> DataFrame:
    """A row for each project of ``assessed``: category, confidence (0 to 100), factors, explanation, days from
    demolition to construction, episode dates, units, value and role counts, and ``more`` aggregates of its events.

    ``area``: (project_id, area_class); ``market``: (project_id) with a listing signal. Events are dealt once, by project;
    all windows and the aggregate follow that (``dealt``: they lie so already, which large tables should by ``session.dealt``). Phrases may span the texts of events that follow one another in an
    episode: each text is searched with as many following ones as a phrase has words, so that no project's texts are ever
    gathered.
    """
    own = _sited(measured(assessed, config, more, dealt), area, market)
    return _judged(own, config).drop("any_commercial", "says_commercial", *[f"form_{name}" for name in FORMS])


def measured(assessed: DataFrame, config: ScoringConfig = DEFAULT, more: list[Column] = (), dealt: bool = False) -> DataFrame:
    """What ``classify`` counts of each project before any weight: of the policy, only the gap and the words matter here."""
    c = F.col
    own = episode.mark_episode(assessed if dealt else assessed.repartition("project_id"), config.gap_days)
    here = c("in_episode")
    width = lambda *lists: max(len(text.phrase(k).split()) for name in lists for k in config.keywords[name])
    by = Window.partitionBy("project_id", "in_episode").orderBy("position")
    among = Window.partitionBy("project_id", "in_episode", "new_residential").orderBy("position")  # forms are sought in new buildings' texts alone
    # one window after another, each reduced to what it tells, so that no sort carries the texts that a window before it joined
    own = own.withColumn("_days", episode.days_since(["project_id", "in_episode"], "event_time", c("demolition") & c("at_site"), c("new_residential") & c("event_time").isNotNull()))
    own = own.withColumn("_all", _padded(F.collect_list("t_all").over(by.rowsBetween(0, width("commercialOrIndustrial") - 1))))
    own = own.withColumn("says_commercial", text.holds_any("_all", config.keywords["commercialOrIndustrial"])).drop("_all", "t_all")
    own = own.withColumn("_form", _padded(F.collect_list("t_form").over(among.rowsBetween(0, width(*FORMS) - 1))))
    own = own.withColumns({f"form_{name}": c("new_residential") & text.holds_any("_form", config.keywords[name]) for name in FORMS})
    found = {name: c(name) for name in ["says_commercial", *[f"form_{name}" for name in FORMS]]}
    flags = {
        "has_demolition": c("demolition") & c("at_site"), "has_new": c("new_residential"), "has_language": c("new_dwelling"), "has_residential": c("residential"), "has_renovation": c("renovation"),
    } | found
    counts = {
        "n_episode": F.lit(True), "n_dev": c("dev_permit") & c("new_residential"), "n_bldg": c("bldg_permit") & c("new_residential"), "n_either": (c("dev_permit") | c("bldg_permit")) & c("new_residential"),
    }
    return own.groupBy("project_id").agg(
        F.count("*").alias("n_events"), F.count_if(c("role") == "PROPERTY_ONLY").alias("n_property_only"), F.count_if(c("role") == "EXCLUDED").alias("n_excluded"), F.bool_or("s_commercial").alias("any_commercial"),
        *[F.bool_or(here & test).alias(name) for name, test in flags.items()], *[F.count_if(here & test).alias(name) for name, test in counts.items()],
        F.max(F.when(here, c("units"))).alias("units"), F.max(F.when(here, c("value"))).alias("value"), F.min(F.when(here, c("_days"))).alias("demolition_to_construction_days"),
        F.min("episode_start").alias("infill_start_date"), F.max("episode_end").alias("latest_infill_activity_date"), *more,
    )


def _sited(own: DataFrame, area: DataFrame | None, market: DataFrame | None) -> DataFrame:
    own = own.join(area, "project_id", "left") if area is not None else own.withColumn("area_class", F.lit("UNKNOWN"))
    listed = market.select("project_id", F.lit(True).alias("listed")).distinct() if market is not None else None
    own = own.join(listed, "project_id", "left") if listed is not None else own.withColumn("listed", F.lit(False))
    return own.withColumns({"area_class": F.coalesce("area_class", F.lit("UNKNOWN")), "listed": F.coalesce("listed", F.lit(False))})


def _judged(own: DataFrame, config: ScoringConfig) -> DataFrame:
    """Category, points, confidence and explanation of measured projects: projections alone."""
    c = F.col
    own = own.withColumns({
        "commercial": c("says_commercial") | ((c("n_episode") == 0) & F.coalesce("any_commercial", F.lit(False))),
        "within_window": F.coalesce(c("demolition_to_construction_days") <= config.window_days, F.lit(False)),
    })
    own = own.withColumn("category", category()).withColumn("factors", factors(config))
    own = own.withColumn("confidence", F.when(c("commercial"), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate("factors", F.lit(0), lambda total, f: total + f["points"])))))
    sentence = F.when(c("within_window"), F.concat(F.lit("Demolition preceded construction by "), c("demolition_to_construction_days"), F.lit(" days.")))
    label = text.label(c("category"))
    return own.withColumn("explanation", F.concat_ws(" ", F.concat(label, F.lit(" with a confidence score of "), c("confidence"), F.lit("/100.")), F.nullif(F.concat_ws(" ", F.transform("factors", lambda f: f["message"])), F.lit("")), sentence))


def _padded(texts: Column) -> Column:
    return F.concat(F.lit(" "), F.concat_ws(" ", texts), F.lit(" "))


def category() -> Column:
    c = F.col
    form = lambda name: c(f"form_{name}")
    detached = F.when(c("listed"), "PROBABLE_NEW_DETACHED_INFILL_FOR_RESALE").otherwise("PROBABLE_NEW_DETACHED_INFILL")
    built = (
        F.when(form("gardenSuite"), "PROBABLE_GARDEN_SUITE").when(form("rowHousing"), "PROBABLE_ROW_HOUSING").when(form("semiDetached"), "PROBABLE_SEMI_DETACHED_INFILL")
        .when(form("duplex"), "PROBABLE_DUPLEX").when(form("detached"), detached).otherwise("UNCERTAIN_RESIDENTIAL_DEVELOPMENT")
    )
    return (
        F.when(c("commercial"), "NOT_RELEVANT").when(c("has_new"), built).when(c("has_demolition"), "DEMOLITION_ONLY").when(c("has_renovation"), "RENOVATION_OR_ADDITION")
        .when(c("has_residential"), "UNCERTAIN_RESIDENTIAL_DEVELOPMENT").otherwise("NOT_RELEVANT")
    )


def factors(config: ScoringConfig = DEFAULT) -> Column:
    """The rules that apply, in order, with points and messages; commercial projects have one of no points."""
    c = F.col
    rules = [
        ("demolitionAtSameAddress", c("has_demolition") & (~c("has_new") | c("within_window")), F.lit("A demolition was found at the site.")),
        ("newResidentialConstruction", c("has_new"), F.lit("New residential construction was found.")),
        ("developmentAndBuildingPermit", (c("n_dev") >= 1) & (c("n_bldg") >= 1) & (c("n_either") >= 2), F.lit("There are a development and a building permit.")),
        ("newDwellingLanguage", c("has_language"), F.lit("The work is described as a new dwelling.")),
        ("twoOrMoreUnits", F.coalesce(c("units") >= 2, F.lit(False)), F.concat(F.lit("Units added: "), c("units"), F.lit("."))),
        ("recognizedResidentialBuildingType", c("has_residential"), F.lit("The building type is residential.")),
        ("constructionValueAboveThreshold", F.coalesce(c("value") > config.high_value, F.lit(False)), F.lit(f"The construction value exceeds {config.high_value:,.0f}.")),
        ("renovationOnly", c("has_renovation") & ~c("has_new"), F.lit("Only renovation is described.")),
        ("outsideCoreInfillArea", c("area_class") == "OUTSIDE_CORE", F.lit("The site is outside the core area.")),
    ]
    made = lambda name, points, message: F.struct(F.lit(name).alias("rule"), F.lit(points).alias("points"), message.alias("message"))
    all_rules = F.filter(F.array(*[F.when(test, made(name, config.weights[name], message)) for name, test, message in rules]), lambda f: f.isNotNull())
    return F.when(c("commercial"), F.array(made("commercialOrIndustrialExclusion", 0, F.lit("Commercial or industrial language excludes the project.")))).otherwise(all_rules)


def project_area(projects: DataFrame, permit_addresses: DataFrame) -> DataFrame:
    """(project_id, area_class): of the project's own coordinates, else of its permits' where those agree."""
    own = projects.select("project_id", geo.area_class(F.col("latitude"), F.col("longitude")).alias("own"))
    linked = permit_addresses.select("project_id", geo.area_class(F.col("latitude"), F.col("longitude")).alias("c")).filter("c <> 'UNKNOWN'")
    agreed = linked.groupBy("project_id").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low = high").select("project_id", F.col("low").alias("agreed"))
    return own.join(agreed, "project_id", "left").select("project_id", F.when(F.col("own") != "UNKNOWN", F.col("own")).otherwise(F.coalesce("agreed", F.lit("UNKNOWN"))).alias("area_class"))


def market_review(category: Column, occupancy: Column, checked: Column) -> Column:
    return F.coalesce(category.isin(MARKET_REVIEW), F.lit(False)) & occupancy.isNotNull() & (checked.isNull() | (checked < occupancy))


def states(permits: DataFrame, config: ScoringConfig = DEFAULT, area: DataFrame | None = None, actions: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """Project state out of silver permits: classification, stage of the episode, dates of all milestones, review flag,
    and the overrides of an action log (see ``apply_actions``). Writes nothing, so that it also previews a policy."""
    # raw columns are dealt, which are smaller than the texts made of them
    assessed = assess.signals(dealt_by(permits, "project_id"), config, ascii_only)
    assessed = timeline.told(assessed)
    more = [*timeline.told_aggregates(F.col("in_episode")), F.min("_first").alias("earliest_date"), F.max("_latest").alias("latest_date"), F.max("occupancy_date").alias("latest_occupancy")]
    classified = classify(assessed, config, area, more=more, dealt=True)
    return apply_actions(classified.withColumn("stage", timeline.stage_of()).drop("_occupied", "_cancelled", "_rank"), actions)


def preview(permits: DataFrame, after: ScoringConfig, before: ScoringConfig = DEFAULT, area: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """(project_id, before, after) of the projects that another policy would see in another way, each side a struct of
    category, stage, confidence and explanation; nothing is written. Policies that share gap and words share everything up
    to one row for each project, which is judged twice; those that share the words share the signals and their shuffle.
    Confidences may differ where categories do not."""
    c, sides = F.col, ["category", "stage", "confidence", "explanation"]
    more, marked = timeline.told_aggregates(c("in_episode")), timeline.told
    view = lambda own, config: _judged(own, config).withColumn("stage", timeline.stage_of())
    if before.keywords != after.keywords or before.gap_days != after.gap_days:
        # signals before the shuffle: with equal words both sides read one exchange
        signals = lambda config: marked(dealt_by(assess.signals(permits, config, ascii_only), "project_id", like=permits))
        side = lambda config, name: view(_sited(measured(signals(config), config, more, dealt=True), area, None), config).select("project_id", F.struct(*sides).alias(name))
        both = side(before, "before").join(side(after, "after"), "project_id")
    else:
        signals = marked(assess.signals(dealt_by(permits, "project_id"), before, ascii_only))
        own = _sited(measured(signals, before, more, dealt=True), area, None)
        first = view(own, before).withColumn("before", F.struct(*sides))
        both = view(first, after).select("project_id", "before", F.struct(*sides).alias("after"))
    differs = [c(f"before.{n}").eqNullSafe(c(f"after.{n}")) for n in ("category", "stage", "confidence")]
    return both.filter(~(differs[0] & differs[1] & differs[2]))


#: Actions of a reviewer that change a project, and what each sets.
ACTIONS = {"CATEGORY": "category", "STAGE": "stage", "MARKET_CHECK": "market_checked", "NOT_RELEVANT": "category", "MERGE": "merged_into"}


def audit(actions: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, seq, at, field, before, after): a row for each action of the log (project_id, action, value, at, seq) in
    the order in which it took effect on its project's field. ``before`` is what the last action left, or else the project's
    own (``projects`` has project_id, category and stage). NOT_RELEVANT sets the category of that name."""
    c = F.col
    field = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    own = actions.select("project_id", "at", "seq", F.try_element_at(field, c("action")).alias("field"), F.when(c("action") == "NOT_RELEVANT", "NOT_RELEVANT").otherwise(c("value")).alias("after"))
    own = own.filter(c("field").isNotNull()).join(projects.select("project_id", "category", "stage"), "project_id", "left")
    first = F.when(c("field") == "category", c("category")).when(c("field") == "stage", c("stage"))
    last = F.lag("after").over(Window.partitionBy("project_id", "field").orderBy("at", "seq", "after"))
    return own.withColumn("_last", last).select("project_id", "seq", "at", "field", F.coalesce("_last", first).alias("before"), "after")


def reassign(events: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with the project that a reviewer moved them to, and the audit rows (event_id, seq, at, before, after).

    ``actions`` (event_id, project_id, at, seq): the latest of an event wins (ties: the greatest project_id); its match_reason becomes ``manual``, so that no
    later run moves it back. Actions on events that are not there have no effect and no audit row."""
    c = F.col
    moves = actions.select("event_id", c("project_id").alias("after"), "at", "seq")
    last = moves.groupBy("event_id").agg(F.max_by("after", F.struct("at", "seq", "after")).alias("_to"))
    moved = events.join(last, "event_id", "left").withColumns({
        "project_id": F.coalesce("_to", "project_id"), "match_reason": F.when(c("_to").isNotNull(), "manual").otherwise(c("match_reason") if "match_reason" in events.columns else F.lit(None)),
    }).drop("_to")
    before = F.coalesce(F.lag("after").over(Window.partitionBy("event_id").orderBy("at", "seq", "after")), c("_own"))
    rows = moves.join(events.select("event_id", c("project_id").alias("_own")), "event_id").withColumn("before", before)
    return moved, rows.select("event_id", "seq", "at", "before", "after")


def apply_actions(projects: DataFrame, actions: DataFrame | None) -> DataFrame:
    """Fold an append-only log (project_id, action, value, at, seq) into the projects: the latest category and stage
    override and market check of each win over what was computed."""
    base = projects
    if actions is None:
        for name in ("category_override", "stage_override"):
            base = base.withColumn(name, F.lit(None).cast("string"))
        base = base.withColumn("market_checked", F.lit(None).cast("date"))
    else:
        latest = lambda kind: F.max_by(F.when(F.col("action") == kind, F.col("value")), F.when(F.col("action") == kind, F.struct("at", "seq")))
        folded = actions.groupBy("project_id").agg(latest("CATEGORY").alias("category_override"), latest("STAGE").alias("stage_override"), latest("MARKET_CHECK").cast("date").alias("market_checked"))
        base = base.join(folded, "project_id", "left")
    return base.withColumns({"effective_category": F.coalesce("category_override", "category"), "effective_stage": F.coalesce("stage_override", "stage")}).withColumn("requires_market_review", market_review(F.col("effective_category"), F.col("latest_occupancy"), F.col("market_checked")))


class MergeCycle(ValueError):
    """Projects that were merged into one another."""


def flatten_merges(merges: DataFrame) -> DataFrame:
    """(source, target) with chains followed to their ends, by doubling: each round follows twice as many steps, and is
    checkpointed, so that no round plans the ones before it. A chain of n merges is done after log2(n) + 1 rounds; what still
    moves then goes round in a cycle, which is an error."""
    current = checkpointed(merges.select("source", "target"))
    rounds = current.count().bit_length() + 1
    while True:
        onward = current.select(F.col("source").alias("target"), F.col("target").alias("next"))
        step = checkpointed(current.join(onward, "target", "left").select("source", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved")))
        moving = step.filter("moved").select("source").limit(5).collect()  # a sample for the message
        if not moving:
            return step.select("source", "target")
        if rounds == 0:
            raise MergeCycle(", ".join(str(r.source) for r in moving))
        rounds -= 1
        current = step.select("source", "target")


def repoint(rows: DataFrame, merges: DataFrame, column: str = "project_id") -> DataFrame:
    """The rows with their project replaced by what it was merged into."""
    own = merges.select(F.col("source").alias(column), F.col("target").alias("_target"))
    return rows.join(own, column, "left").withColumn(column, F.coalesce("_target", column)).drop("_target")
