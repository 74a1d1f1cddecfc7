"""Sinks of the read models: CSV lines, JSON and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

MOST_ROWS = 25_000
HEADINGS = [
    "Address", "Neighbourhood", "Category", "Stage", "Confidence score", "Infill start", "Latest infill milestone", "Estimated units", "Construction value (CAD)", "Review status",
    "Latest linked property permit type", "Latest linked property permit subtype", "Latest linked property permit status", "Project URL",
]
MARK = "﻿"


class ExportTooLarge(ValueError):
    pass


def plain_number(value: Column) -> Column:
    """A number without trailing zeros, as scripts print it."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"0+$", ""), r"\.$", "")


def csv_line(items: DataFrame) -> Column:
    """One line of 14 cells for a list item."""
    c = F.col
    url = F.concat(F.lit("/projects/"), text.uri_part(c("project_id")))
    cells = [
        c("street"), c("neighbourhood_name"), c("category_label"), c("stage_label"), c("confidence"), c("infill_start_date"), c("latest_infill_activity_date"), c("units"), plain_number(c("value")), c("review_status_label"),
        c("latest_event.permit_type"), c("latest_event.permit_subtype"), c("latest_event.status"), url,
    ]
    return F.concat_ws(",", *[text.guarded_cell(x.cast("string")) for x in cells])


def csv_lines(items: DataFrame) -> DataFrame:
    return items.select("project_id", csv_line(items).alias("line"))


def write_csv(items: DataFrame, path: str, order: list[Column], most: int = MOST_ROWS) -> None:
    """One file with a byte-order mark, headings and CRLF line ends; refuses more than ``most`` rows. The only sink with a
    single task: its size is bounded by that check."""
    total = items.limit(most + 1).count()
    if total > most:
        raise ExportTooLarge(f"more than {most:,} rows; narrow the filters")
    lines = items.select(F.row_number().over(Window.orderBy(*order)).alias("n"), csv_line(items).alias("value"))
    heading = items.sparkSession.createDataFrame([(0, MARK + ",".join(HEADINGS))], "n int, value string")
    heading.unionByName(lines).coalesce(1).sortWithinPartitions("n").select("value").write.option("lineSep", "\r\n").text(path)


def json_items(items: DataFrame) -> DataFrame:
    """A JSON document for each item; dates as YYYY-MM-DD, decimals as numbers, nulls written."""
    return items.select("project_id", F.to_json(F.struct(*[c for c in items.columns]), {"ignoreNullFields": "false"}).alias("json"))


def features(markers: DataFrame) -> DataFrame:
    """A GeoJSON feature for each marker."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("longitude"), F.col("latitude")).alias("coordinates"))
    own = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("project_id", "title", "category", "confidence").alias("properties"))
    return markers.select("project_id", F.to_json(own).alias("feature"))


def feature_collection(markers: DataFrame, most: int = 10_000) -> DataFrame:
    """One GeoJSON document of at most ``most`` markers, the most confident (ties by project_id), with ``truncated``: whether
    there were more. One document is one value, so that its bound is part of the format."""
    first = features(markers.orderBy(F.desc("confidence"), "project_id").limit(most + 1)).join(markers.select("project_id", "confidence"), "project_id")
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), "project_id", "feature")))
    listed = F.array_join(F.transform(F.slice(sorted_, 1, most), lambda f: f["feature"]), ",")
    truncated = F.when(F.count("*") > most, "true").otherwise("false")
    return first.agg(F.concat(F.lit('{"type":"FeatureCollection","truncated":'), truncated, F.lit(',"features":['), listed, F.lit("]}")).alias("json"))
