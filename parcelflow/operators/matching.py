"""Permits to projects by site, duplicate permits, and the keys behind both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import address, text


def project_key(site: Column) -> Column:
    """A stable key, so that a repeated run finds its own projects again."""
    return F.when(site != "", F.concat(F.lit("site:"), F.sha2(site, 256)))


def match_sites(permits: DataFrame, projects: DataFrame) -> DataFrame:
    """``permits`` (event_id, site_key, address_key) with the ``project_id`` of their site (null for none): a project with
    the very same address_key first, then the smallest project_id. Projects with an empty key match nothing.

    Both lookups are equi-joins on a table that has a row for each key, so that no key multiplies rows.
    """
    sited = projects.filter(F.col("site_key") != "")
    by_site = sited.groupBy("site_key").agg(F.min("project_id").alias("_any"))
    by_unit = sited.filter(F.col("address_key") != "").groupBy("site_key", "address_key").agg(F.min("project_id").alias("_exact"))
    own = permits.join(by_site, "site_key", "left").join(by_unit, ["site_key", "address_key"], "left")
    return own.withColumn("project_id", F.coalesce("_exact", "_any")).drop("_exact", "_any")


def match_keys(permits: DataFrame, projects: DataFrame) -> DataFrame:
    """``permits`` (event_id, site_key, address_id) with ``project_id`` and ``match_by`` (site, key or null).

    Of the projects at a permit's site that were not merged, one with the very same address comes first, then the smallest
    project_id. Where there is none, the project that a former run made for the site (by ``project_key``), or what it was
    merged into: one hop. ``valid`` is false where that is merged in its turn. ``projects``: project_id, site_key, address_id,
    project_key, merged_into."""
    c = F.col
    live = projects.filter(c("merged_into").isNull() & (c("site_key") != ""))
    by_site = live.groupBy("site_key").agg(F.min("project_id").alias("_any"))
    exact = live.filter(c("address_id").isNotNull()).groupBy("site_key", "address_id").agg(F.min("project_id").alias("_exact"))
    keyed = projects.filter(c("project_key").isNotNull()).select(c("project_key").alias("_key"), c("project_id").alias("_made"), c("merged_into").alias("_into"))
    after = projects.select(c("project_id").alias("_into"), c("merged_into").isNull().alias("_sound"))
    own = permits.withColumn("_key", project_key(c("site_key"))).join(by_site, "site_key", "left").join(exact, ["site_key", "address_id"], "left").join(keyed.join(after, "_into", "left"), "_key", "left")
    site = F.coalesce("_exact", "_any")
    return own.withColumns({
        "project_id": F.coalesce(site, "_into", "_made"), "match_by": F.when(site.isNotNull(), "site").when(c("_made").isNotNull(), "key"),
        "valid": site.isNotNull() | c("_into").isNull() | F.coalesce("_sound", F.lit(False)),
    }).drop("_any", "_exact", "_key", "_made", "_into", "_sound")


def job_result(matched: DataFrame, samples: int = 10) -> DataFrame:
    """One line for a matching run: processed, matched, failed, and at most so many failures (event_id and reason), the
    smallest event_ids. The samples are a top-k, so that failures are never gathered."""
    c = F.col
    counts = matched.agg(F.count("*").alias("processed"), F.count_if(c("match_status") == "MATCHED").alias("matched"), F.count_if(c("match_status") != "MATCHED").alias("failed"))
    some = matched.filter(c("match_status") != "MATCHED").select("event_id", c("match_status").alias("reason")).orderBy("event_id").limit(samples)
    return counts.join(some.agg(F.array_sort(F.collect_list(F.struct("event_id", "reason"))).alias("failures")), F.lit(True))  # a row on each side


def assign_projects(permits: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a matching run does: permits with project_id, ``match_status`` and ``match_reason``, and the new projects.

    A permit without a site key is UNMATCHABLE. A site without a project gets one, named by the site's key, with address
    and neighbourhood of its first permit (first_observed_at, event_id); where that lacks a neighbourhood the site's
    permits stay UNMATCHED.
    """
    own = match_sites(permits, projects)
    first = F.struct("first_observed_at", "event_id", "address_key", "neighbourhood_id")
    made = own.filter((F.col("site_key") != "") & F.col("project_id").isNull()).groupBy("site_key").agg(F.min(first).alias("f"))
    made = made.filter(F.col("f.neighbourhood_id").isNotNull()).select(project_key(F.col("site_key")).alias("project_id"), "site_key", "f.address_key", "f.neighbourhood_id")
    own = own.join(made.select("site_key", F.col("project_id").alias("_new")), "site_key", "left")
    found = F.col("project_id").isNotNull()
    own = own.withColumns({
        "match_reason": F.when(found, "normalized-site-address").when(F.col("_new").isNotNull(), "new-site"),
        "match_status": F.when(F.col("site_key") == "", "UNMATCHABLE").when(found | F.col("_new").isNotNull(), "MATCHED").otherwise("UNMATCHED"),
        "project_id": F.coalesce("project_id", "_new"),
    })
    return own.drop("_new"), made


def group_by_site(records: DataFrame, order: list[str]) -> DataFrame:
    """The records with ``n``, how many their site has, and ``place`` among them; those without a key are skipped. Rows
    stay rows: a large site is never gathered into one value."""
    by = Window.partitionBy("site_key")
    return records.filter(F.col("site_key") != "").withColumns({"n": F.count("*").over(by), "place": F.row_number().over(by.orderBy(*order))})


def permit_identity(provider: Column, record: Column) -> Column:
    """permit:v1:provider:record, percent-encoded; null if either part is missing."""
    own, rec = F.lower(text.strip(provider)), text.strip(record.cast("string"))
    return F.when((own != "") & (rec != ""), F.concat(F.lit("permit:v1:"), text.uri_part(own), F.lit(":"), text.uri_part(rec)))


def first_wins(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``. Nulls in a key are equal to one another."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def rekey_legacy(permits: DataFrame, raw_address: str = "raw_address") -> DataFrame:
    """Replay the address rules over stored raw addresses. ``moved`` marks permits whose site key is another now;
    automated links of those are taken back (project_id null), those made by people stay."""
    own = address.normalize(permits.withColumnRenamed("site_key", "_old_site"), raw_address)
    moved = ~F.col("site_key").eqNullSafe(F.col("_old_site"))
    return own.withColumn("moved", moved).withColumn("project_id", F.when(moved & ~F.coalesce(F.col("match_reason") == "manual", F.lit(False)), F.lit(None)).otherwise(F.col("project_id"))).drop("_old_site")


#: The fields that tell a payload's dataset, and the endings of providers' names.
PAYLOAD_FIELDS = {"building": ("job_category", "issue_date"), "development": ("city_file_number", "permit_date")}
PROVIDER_ENDINGS = {"building": ":24uj-dj8v", "development": ":2ccn-pwtu"}


def dataset_provenance(payload: Column, provider: Column, known: Column | None = None) -> Column:
    """The dataset that a stored payload came from: what is known, else by its fields (a null field is present too), else
    by the provider's name, else null."""
    keys = F.json_object_keys(payload)
    has = lambda name: F.coalesce(F.array_contains(keys, name), F.lit(False))
    by_field = [F.when(has(a) & has(b), name) for name, (a, b) in PAYLOAD_FIELDS.items()]
    by_name = [F.when(provider.endswith(end), name) for name, end in PROVIDER_ENDINGS.items()]
    return F.coalesce(*([known] if known is not None else []), *by_field, *by_name)
