"""Permit extracts: file scans with a column contract, and rows made uniform, with an error code where they are not."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import address, text
from .snapshot import Checkpoint

# The columns asked of each dataset, and those that must be there.
DEVELOPMENT_COLUMNS = """
city_file_number permit_type permit_class permit_date status description_of_development address legal_description neighbourhood_id neighbourhood
neighbourhood_classification ward bia zoning land_parcel_count latitude longitude
"""
DEVELOPMENT_REQUIRED = "city_file_number permit_type permit_date address neighbourhood_id latitude longitude"
BUILDING_COLUMNS = """
row_id issue_date permit_number permit_date year month_number job_category job_description building_type work_type construction_value floor_area
units_added address legal_description zoning neighbourhood_numberr neighbourhood bia count latitude longitude occupancy_granted_date
"""
BUILDING_REQUIRED = "row_id issue_date job_category address neighbourhood_numberr occupancy_granted_date latitude longitude"
DATE_FIELDS = {"development": ["permit_date"], "building": ["issue_date", "permit_date"]}
# end of the fixed values


class SchemaDrift(ValueError):
    """A source that lacks a column it must have, or has it in another type."""


@dataclass(frozen=True)
class Dataset:
    name: str
    dataset_id: str
    key: str
    columns: tuple[str, ...]
    required: tuple[str, ...]


DATASETS = {
    "development": Dataset("development", "2ccn-pwtu", "city_file_number", tuple(DEVELOPMENT_COLUMNS.split()), tuple(DEVELOPMENT_REQUIRED.split())),
    "building": Dataset("building", "24uj-dj8v", "row_id", tuple(BUILDING_COLUMNS.split()), tuple(BUILDING_REQUIRED.split())),
}
PROVIDER = "city-open-data"
#: What the names of columns begin with that a run adds to raw rows; ``normalize`` hands them on as they are.
ADDED = ":run_"


def raw_schema(dataset: Dataset) -> StructType:
    """Every source column as text, with the system's own two; nothing is inferred."""
    return StructType([StructField(n, StringType()) for n in (":id", ":updated_at", *dataset.columns)])


def read_json(spark: SparkSession, path: str, dataset: Dataset) -> DataFrame:
    """A snapshot of JSON lines."""
    return spark.read.schema(raw_schema(dataset)).json(path)


def check_contract(df: DataFrame, dataset: Dataset) -> None:
    missing = [c for c in dataset.required if c not in df.columns]
    if missing:
        raise SchemaDrift(f"{dataset.name}: missing {', '.join(missing)}")


def schema_fingerprint(df: DataFrame) -> str:
    """A digest of the sorted ``field:type`` lines, a part of a snapshot's checkpoint."""
    lines = sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def metadata(df: DataFrame, dataset: Dataset) -> Checkpoint:
    """What tells a snapshot of files from another: its columns and types, its rows and its revision (the newest file's
    time of change). One pass over the files' rows, without any column."""
    row = df.agg(F.count("*").alias("rows"), F.max("_metadata.file_modification_time").cast("string").alias("revision")).first()
    return Checkpoint(dataset.name, dataset.dataset_id, row.revision or "", schema_fingerprint(df), row.rows)


def in_dates(df: DataFrame, dataset: Dataset, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows whose permit date lies in the range, both ends counted; plain comparisons, so that a scan can skip."""
    column = F.col("permit_date" if dataset.name == "development" else "issue_date")
    if start:
        df = df.filter(column >= start)
    if end:
        df = df.filter(column <= f"{end}T23:59:59.999")
    return df


def payload(df: DataFrame, names: list[str] | None = None) -> Column:
    """Canonical JSON of a row: keys in order, nulls written, the system's keys left out."""
    kept = sorted(n for n in (names or df.columns) if not n.startswith(":"))
    return F.to_json(F.struct(*[F.col(f"`{n}`") for n in kept]), {"ignoreNullFields": "false"})


def checksum(json: Column) -> Column:
    return F.sha2(json, 256)


def identified(raw: DataFrame, dataset: Dataset) -> DataFrame:
    """The raw rows with their checksum and record_key, as ``normalize`` has them: what a run must know of rows that it has
    seen before, without reading any of their values."""
    check_contract(raw, dataset)
    own = raw.withColumn("checksum", checksum(payload(raw)))
    return own.withColumn("record_key", _record_key(text.clean(F.col(f"`{dataset.key}`"), 200)))


def _record_key(identifier: Column) -> Column:
    return F.coalesce(identifier, F.concat(F.lit("invalid:"), "checksum"))


def normalize(raw: DataFrame, dataset: Dataset) -> DataFrame:
    """A row for each raw row: the uniform permit, payload, checksum, and error_code and error_message (null if it is
    sound). MISSING_SOURCE_ID comes before INVALID_SOURCE_ROW; a row without an identifier is named by its checksum."""
    check_contract(raw, dataset)
    added = [F.col(f"`{n}`") for n in raw.columns if n.startswith(ADDED)]
    own = raw.withColumns({n: F.lit(None).cast("string") for n in (":id", ":updated_at", *dataset.columns) if n not in raw.columns})
    c = lambda name: F.col(f"`{name}`").cast("string")
    clean = lambda name, size: text.clean(c(name), size)
    null = F.lit(None)
    building = dataset.name == "building"
    issue = text.civil_date(F.coalesce(c("issue_date"), c("permit_date")) if building else c("permit_date"))
    bad_dates = [F.when(text.clean(c(n), 100).isNotNull() & text.civil_date(c(n)).isNull(), F.lit(f"{n}: no calendar date")) for n in DATE_FIELDS[dataset.name]]
    bad_occupancy = F.when(clean("occupancy_granted_date", 100).isNotNull() & text.strict_date(c("occupancy_granted_date")).isNull(), "occupancy_granted_date: no calendar date") if building else null.cast("string")
    permit = {
        "source_provider": F.lit(PROVIDER), "source_dataset": F.lit(dataset.name), "source_dataset_id": F.lit(dataset.dataset_id), "source_record_id": clean(dataset.key, 200),
        "system_id": clean(":id", 200), "source_updated_at": text.instant(c(":updated_at")),
        "permit_number": clean("permit_number" if building else dataset.key, 200),
        "permit_type": F.coalesce(clean("job_category" if building else "permit_type", 300), F.lit("Building Permit" if building else "Development Permit")),
        "permit_subtype": clean("work_type" if building else "permit_class", 300), "application_date": null.cast("date"), "issue_date": issue,
        "status": F.lit("Issued") if building else clean("status", 200), "description": clean("job_description" if building else "description_of_development", 50_000),
        "building_type": clean("building_type", 500) if building else null.cast("string"), "construction_value": text.decimal_text(c("construction_value")) if building else null.cast("string"),
        "units": text.integer(c("units_added")) if building else null.cast("long"), "occupancy_date": text.strict_date(c("occupancy_granted_date")) if building else null.cast("date"),
        "raw_address": clean("address", 1_000), "neighbourhood_city_id": clean("neighbourhood_numberr" if building else "neighbourhood_id", 100), "neighbourhood_name": clean("neighbourhood", 500),
        "latitude": text.number(c("latitude")), "longitude": text.number(c("longitude")),
    }
    own = own.withColumns({"payload": payload(raw), "_bad": F.coalesce(*bad_dates, bad_occupancy)} | permit)
    own = own.withColumn("checksum", checksum(F.col("payload"))).select("payload", "checksum", "_bad", *permit, *added)
    own = address.normalize(own.withColumnRenamed("raw_address", "_address"), "_address").drop("_address")
    broken = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("units").between(-100_000, 100_000), F.lit(True)), "units: out of bounds"),
        F.when(~F.coalesce(F.col("latitude").between(-90, 90), F.lit(True)), "latitude: out of bounds"),
        F.when(~F.coalesce(F.col("longitude").between(-180, 180), F.lit(True)), "longitude: out of bounds"),
        F.when(F.col("site_key") == "", "address: no complete civic address"),
    ))
    invalid = F.coalesce(F.col("_bad"), F.when(F.size(broken) > 0, F.array_join(broken, "; ")))
    return own.withColumns({
        "error_code": F.when(F.col("source_record_id").isNull(), "MISSING_SOURCE_ID").when(invalid.isNotNull(), "INVALID_SOURCE_ROW"),
        "error_message": text.failure_message(F.when(F.col("source_record_id").isNull(), f"{dataset.key}: missing").otherwise(invalid)),
        "record_key": _record_key(F.col("source_record_id")),
    }).drop("_bad")
