"""Rules over literal texts, and small functions that no other query reads alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import address, text
from ..operators import assess, filters, project, readmodel
from ..session import checkpointed
from ..sources import export, permits, snapshot
from . import binding
from .catalogue import query

#: dataset, type, subtype, description, building type, status, units; then, worked out by hand, the role and the signals:
#: d demolition, n new home, r residential, v renovation, w new dwelling said, p property only, D and B the kind of permit
RULES = [
    ("building", "House Combo Permit", "(01) New", "To construct a duplex", None, "Issued", None, "PRINCIPAL_RESIDENTIAL", "nrB"),
    ("development", "Development Permit", "Class B", "Erect a new row house", None, "Approved", None, "PRINCIPAL_RESIDENTIAL", "nrD"),
    ("building", "Building Permit", "(01) New", "Construction of two storey 4 dwelling units of row housing", None, None, None, "PRINCIPAL_RESIDENTIAL", "nrB"),
    ("building", "Garage", "(01) New", "New garage suite with a deck", None, None, None, "PRINCIPAL_RESIDENTIAL", "nrB"),
    ("building", "Home Improvement Permit", "(03) Alteration", "Convert garden suite to storage shed", None, None, None, "PROPERTY_ONLY", "pB"),
    ("building", "Demolition Permit", None, "Remove existing house and detached garage", None, None, None, "PROPERTY_ONLY", "pB"),
    ("building", "Demolition Permit", None, "Demolish semi-detached house and garage", None, None, None, "PRINCIPAL_DEMOLITION", "drB"),
    ("building", "Building Permit", "(02) Addition", "Addition to a single detached house", None, None, None, "RESIDENTIAL_SUPPORTING", "rvB"),
    ("building", "Commercial Final", None, "New restaurant", None, None, None, "EXCLUDED", "B"),
    ("building", "Single Detached House", "(01) New", "New house", None, "Cancelled", None, "EXCLUDED", "wB"),
    (None, "Development Application", None, "New two storey single detached dwelling", None, None, None, "PRINCIPAL_RESIDENTIAL", "nrwD"),
    (None, "Building Permit", "New", "Cluster housing", None, None, 3, "PRINCIPAL_RESIDENTIAL", "nrB"),
    (None, "Building Permit", "New", "Cluster housing", None, None, None, "RESIDENTIAL_SUPPORTING", "rB"),
    ("building", "Building Permit", "(01) New", "Detached house", None, None, None, "PRINCIPAL_RESIDENTIAL", "nrB"),
    ("building", "Hot Tub", None, "Hot tub", None, None, None, "PROPERTY_ONLY", "pB"),
    ("building", "Permit", None, "Change of occupancy", None, None, 2, "RESIDENTIAL_SUPPORTING", "B"),
    ("building", "Permit", None, "Sign", None, None, None, "PROPERTY_ONLY", "B"),
    ("building", "Permit", None, "Rénovation of a dwelling", None, None, None, "RESIDENTIAL_SUPPORTING", "rvB"),
    ("development", "Development Permit", None, "To construct a Residential Use Building in the form of a 2 Dwelling unit Semi-Detached House", None, None, None, "PRINCIPAL_RESIDENTIAL", "nrD"),
    ("development", "Development Permit", None, "To change the use of a garden suite", None, None, None, "RESIDENTIAL_SUPPORTING", "rD"),
    ("building", "Building Permit", "(01) New", "Existing garage suite to be removed, new garage", None, None, None, "PROPERTY_ONLY", "pB"),
    ("building", "Building Permit", None, "Interior renovation of warehouse", None, None, None, "EXCLUDED", "B"),
    (None, None, None, None, "Duplex", None, None, "RESIDENTIAL_SUPPORTING", "r"),
    ("building", "Building Permit", None, "Solar panel on single detached house", None, None, None, "PROPERTY_ONLY", "pB"),
    ("building", "Building Permit", None, "Build the one story town house", None, None, None, "PRINCIPAL_RESIDENTIAL", "nrB"),
    ("building", "House Combination", "New", "Basement", None, None, None, "PRINCIPAL_RESIDENTIAL", "nB"),
    ("building", "Building Permit", None, "Repair", None, "Voided", None, "EXCLUDED", "B"),
    ("building", "Building Permit", None, "Construct dwelling", None, None, None, "PRINCIPAL_RESIDENTIAL", "nrwB"),
]
_FIELDS = "dataset string, permit_type string, permit_subtype string, description string, building_type string, status string, units long"
_LETTERS = {"demolition": "d", "new_residential": "n", "residential": "r", "renovation": "v", "new_dwelling": "w", "property_only": "p", "dev_permit": "D", "bldg_permit": "B"}


def _literal(spark: SparkSession, sf_dir: str, rows: list[tuple], fields: str) -> DataFrame:
    """Each part with one of the rows, by its key."""
    own = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {fields}")
    return binding.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(rows)).cast("int").alias("i")).join(F.broadcast(own), "i")  # a list in the code


@query("signal_rules", f"""
with r(i, role, told) as (values {', '.join(f"({i}, '{r[7]}', '{r[8]}')" for i, r in enumerate(RULES))})
select p_partkey, role, {', '.join(f"contains(told, '{letter}') as {name}" for name, letter in _LETTERS.items())} from part join r on i = p_partkey % {len(RULES)}""")
def signal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each rule of the signals and roles, accents, removed suites and unknown datasets among them."""
    own = assess.signals(_literal(spark, sf_dir, [r[:7] for r in RULES], _FIELDS))
    return own.select("p_partkey", "role", *_LETTERS)


#: subtype, description, building type, listed for sale; category and score
FORMS = [
    ("(01) New", "New garage suite", None, False, "PROBABLE_GARDEN_SUITE", 40), (None, "Construct row housing", None, False, "PROBABLE_ROW_HOUSING", 40),
    (None, "Erect a semi-detached house", None, True, "PROBABLE_SEMI_DETACHED_INFILL", 40), (None, "Build a duplex", None, False, "PROBABLE_DUPLEX", 40),
    (None, "New house", "Single Detached House", False, "PROBABLE_NEW_DETACHED_INFILL", 50), (None, "New house", "Single Detached House", True, "PROBABLE_NEW_DETACHED_INFILL_FOR_RESALE", 50),
    (None, "New dwelling", None, False, "UNCERTAIN_RESIDENTIAL_DEVELOPMENT", 50), (None, "Interior renovation of a dwelling", None, False, "RENOVATION_OR_ADDITION", 0),
    (None, "Demolish house", None, False, "DEMOLITION_ONLY", 20), (None, "Sign", None, False, "NOT_RELEVANT", 0), (None, "Retail store", None, False, "NOT_RELEVANT", 0),
]


@query("form_rules", f"""
with r(i, category, score) as (values {', '.join(f"({i}, '{r[4]}', {r[5]})" for i, r in enumerate(FORMS))})
select p_partkey, category, score as confidence from part join r on i = p_partkey % {len(FORMS)}""")
def form_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of one permit each: every category, with and without a listing."""
    own = _literal(spark, sf_dir, [r[:4] for r in FORMS], "permit_subtype string, description string, building_type string, listed boolean")
    own = own.withColumns({"project_id": F.col("p_partkey").cast("string"), "event_id": F.col("p_partkey").cast("string"), "dataset": F.lit("building"), "issue_date": F.lit("2001-02-03").cast("date")})
    found = project.classify(assess.signals(own.drop("listed", "i")), market=own.filter("listed").select("project_id"))
    return found.select(F.col("project_id").cast("long").alias("p_partkey"), "category", "confidence")


_COLUMNS = {"latestEventDate": "latest_infill_activity_date", "earliestEventDate": "infill_start_date", "category": "category", "stage": "stage", "reviewStatus": "review_status", "address": "street", "neighbourhood": "neighbourhood_name"}


def _sort_sql(name: str, way: str) -> str:
    column = _COLUMNS.get(name, name)
    if name in ("category", "stage", "reviewStatus"):
        values = {"category": filters.CATEGORIES, "stage": filters.STAGES, "reviewStatus": filters.REVIEW_STATUSES}[name]
        column = f"list_position([{', '.join(repr(v) for v in values)}], {column})"
    return f"select '{name} {way}' as sort, project_id, place from (select project_id, row_number() over (order by {column} {way} nulls last, project_id) as place from public) where place <= 30"


_SORTS = [(name, way) for name in filters.SORT_COLUMNS for way in ("asc", "desc")]


@query("sort_orders", f"with {binding.GOLD_SQL} " + " union all ".join(_sort_sql(*s) for s in _SORTS))
def sort_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty projects in each of the twenty orders."""
    own = checkpointed(binding.gold(spark, sf_dir).filter(filters.is_public()).select("project_id", *filters.SORT_COLUMNS.values()))
    pages = []
    for name, way in _SORTS:
        keys = filters.order_by(filters.ProjectFilters(sort=name, direction=way))
        first = own.orderBy(*keys).limit(30)
        pages.append(first.select(F.lit(f"{name} {way}").alias("sort"), "project_id", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("place")))
    return reduce(DataFrame.unionByName, pages)


_RAW = "case when o_orderkey % 9 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000' end"


@query("date_range", f"with r as (select o_orderkey, {_RAW} as d from orders) select o_orderkey from r where d >= '1995-03-01' and d <= '1996-02-29T23:59:59.999'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of a range of days, both ends counted."""
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00.000"))
    own = binding.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, day).alias("issue_date"))
    return permits.in_dates(own, permits.DATASETS["building"], "1995-03-01", "1996-02-29").select("o_orderkey")


@query("identity_check", "select case when o_custkey % 4 = 0 then null when o_custkey % 4 = 1 then 'PROVIDER_IDENTITY_MISMATCH' when o_custkey % 4 = 2 then 'PROVIDER_IDENTITY_MISMATCH' end as fault, count(*) as n from orders group by 1")
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal, different, missing on one side, and missing on both."""
    form, key = F.col("o_custkey") % 4, F.col("o_orderkey").cast("string")
    raw = F.when(form != 3, key)
    normal = F.when(form == 0, key).when(form == 1, F.concat(key, F.lit("x")))
    return binding.table(spark, sf_dir, "orders").groupBy(snapshot.identity_mismatch(raw, normal).alias("fault")).agg(F.count("*").alias("n"))


@query("instants", """
select event_id, case event_id % 5 when 0 then (1600000000 + event_id) * 1000 when 1 then 1600000000000 + event_id when 2 then 981173106000 when 3 then null when 4 then -5000 end as millis from events""")
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds, milliseconds, ISO text, junk, and seconds before 1970."""
    i = F.col("event_id")
    forms = [(i + 1_600_000_000).cast("string"), (i + 1_600_000_000_000).cast("string"), F.lit("2001-02-03T04:05:06Z"), F.lit("soon"), F.lit("-5")]
    return binding.table(spark, sf_dir, "events").select("event_id", F.unix_millis(text.instant(F.get(F.array(*forms), (i % 5).cast("int")))).alias("millis"))


@query("marker_size", "with n as (select c_nationkey, count(*) as n from customer group by 1) select c_nationkey, cast(40 + floor(n / (select max(n) from n)::double * 22 + 0.5) as bigint) as diameter from n")
def marker_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = binding.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.max("n").alias("most")), F.lit(True)).select("c_nationkey", readmodel.marker_diameter(F.col("n"), F.col("most")).cast("long").alias("diameter"))  # one row


@query("site_key_resolution", """
with p as (select c_custkey as k, c_custkey % 5 as form, 'edmonton|ab|' || (c_custkey + 10) || ' 5 st nw' as key from customer)
select k, case when form = 4 then '' else key end as site_key from p""")
def site_key_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's key by itself, its street, its raw address, its stored unit-level key, or nothing."""
    k = F.col("c_custkey")
    civic = F.concat((k + 10).cast("string"), F.lit(" 5 Street NW"))
    form, key = k % 5, F.concat(F.lit("edmonton|ab|"), (k + 10).cast("string"), F.lit(" 5 st nw"))
    found = address.resolve_site_key(F.when(form == 0, key).otherwise(""), F.when(form == 1, civic), F.when(form == 2, F.concat(F.lit("Unit 7, "), civic)).otherwise("nowhere"), F.when(form == 3, F.concat(key, F.lit("|unit:7"))))
    return binding.table(spark, sf_dir, "customer").select(k.alias("k"), found.alias("site_key"))


@query("json_models", """
select cast(o_orderkey as varchar) as project_id, '{"project_id":"' || o_orderkey || '","units":' || case when o_custkey % 2 = 0 then cast(o_custkey as varchar) else 'null' end || ',"issue_date":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' as json from orders""")
def json_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    own = binding.table(spark, sf_dir, "orders").select(c("o_orderkey").cast("string").alias("project_id"), F.when(c("o_custkey") % 2 == 0, c("o_custkey")).alias("units"), F.to_date("o_orderdate").alias("issue_date"))
    return export.json_items(own)


@query("development_normalize", """
with r as (select c_custkey as k, c_custkey % 6 as form from customer)
select 'D' || k as source_record_id, case when form in (1, 2) then 'INVALID_SOURCE_ROW' end as error_code, case when form = 3 then 'Development Permit' else 'Minor' end as permit_type, 'Class A' as permit_subtype, case when form <> 1 then date '2003-04-05' end as issue_date,
       case when form = 2 then '' else 'edmonton|ab|' || (k + 1) || ' 7 st nw' end as site_key, case when form = 4 then null else 'Approved' end as status, 'N' || (k % 9) as neighbourhood_city_id from r""")
def development_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw rows of the other dataset: sound ones, bad dates, addresses that are none, missing types."""
    k, form = F.col("c_custkey"), F.col("c_custkey") % 6
    own = binding.table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" D"), k.cast("string")).alias("city_file_number"), F.when(form != 3, "Minor").alias("permit_type"), F.lit("Class A").alias("permit_class"), F.when(form == 1, "5 April 2003").otherwise("2003-04-05T00:00:00.000").alias("permit_date"),
        F.when(form == 4, "  ").otherwise("Approved").alias("status"), F.when(form == 2, "123 GARBAGE NW").otherwise(F.concat((k + 1).cast("string"), F.lit(" - 7 STREET NW"))).alias("address"), F.concat(F.lit("N"), (k % 9).cast("string")).alias("neighbourhood_id"),
        F.lit("53.5").alias("latitude"), F.lit("-113.5").alias("longitude"),
    )
    return permits.normalize(own, permits.DATASETS["development"]).select("source_record_id", "error_code", "permit_type", "permit_subtype", "issue_date", "site_key", "status", "neighbourhood_city_id")


@query("accent_folding", "select c_custkey, trim(regexp_replace(lower(strip_accents(case c_custkey % 3 when 0 then 'Café—Crème ' else 'Ünïtéd Ñame ' end || c_name)), '[^a-z0-9]+', ' ', 'g')) as plain from customer")
def accent_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters whose decomposition both engines know."""
    own = binding.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "Café—Crème ").otherwise("Ünïtéd Ñame "), "c_name").alias("t"))
    return own.select("c_custkey", text.searchable(F.col("t")).alias("plain"))


#: a payload; its name as text, its latitude
PAYLOADS = [
    ('{"name":" a b ","latitude":"53.5"}', "a b", 53.5), ('{"name":5,"latitude":-90}', None, -90.0), ('{"name":"  ","latitude":90.5}', None, None), ('{"latitude":" "}', None, 0.0), ("[1]", None, None),
    ('{"name":null,"latitude":true}', None, None), ("no JSON", None, None), ('{"name":"x","latitude":"north"}', "x", None),
]


@query("payload_fields", f"""
with r(i, name, latitude) as (values {', '.join(f"({i}, {'null' if r[1] is None else repr(r[1])}, {'null' if r[2] is None else r[2]}::double)" for i, r in enumerate(PAYLOADS))})
select p_partkey, name, latitude from part join r on i = p_partkey % {len(PAYLOADS)}""")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _literal(spark, sf_dir, [(r[0],) for r in PAYLOADS], "payload string")
    return own.select("p_partkey", text.payload_text(F.col("payload"), "name").alias("name"), text.payload_coordinate(F.col("payload"), "latitude").alias("latitude"))


@query("failure_text", "select p_partkey, left(p_name || ' ' || repeat('ab', p_size * 20), 1000) as message from part")
def failure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages on one line, of a thousand characters at most."""
    message = F.concat("p_name", F.lit("\r\n\t"), F.repeat(F.lit("ab"), F.col("p_size") * 20))
    return binding.table(spark, sf_dir, "part").select("p_partkey", text.failure_message(message).alias("message"))
