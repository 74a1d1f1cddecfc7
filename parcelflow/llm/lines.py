"""Line dedup by distinct-site spread.

A line (trimmed; blank ones never count) is boilerplate if it stands on ``min_sites`` distinct sites or more.
HyperLogLog sketches of each line hash's sites merge by aggregation, in the tasks that read the lines first;
lines whose estimate is near the threshold get an exact distinct count.
Of each boilerplate line the first occurrence (smallest doc_id, then first in its text) may stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_SITES = 10
#: Estimates within this share of the threshold are counted exactly; the sketch's error is far below it.
BAND = 0.25
SKETCH_LG_K = 12


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def exploded(docs: DataFrame, site: str = "source") -> DataFrame:
    """(row, doc_id, line_no, h, site) of the lines that are not blank; ``row`` tells apart rows that share a doc_id."""
    row = F.xxhash64("doc_id", "text")
    # the row's hash stands below the generator, or it would be taken of the whole text for every line
    split = docs.select(row.alias("row"), F.col("doc_id"), F.col(site).cast("string").alias("site"), F.split("text", "\n").alias("parts"))
    lines = split.select("row", "doc_id", "site", F.posexplode("parts").alias("line_no", "line"))
    return lines.withColumn("line", _trimmed(F.col("line"))).filter("line != ''").select("row", "doc_id", "line_no", F.xxhash64("line").alias("h"), "site")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(h) of the lines on at least ``min_sites`` sites. Null sites count as none."""
    seen = lines.filter(F.col("site").isNotNull()).select("h", "site")
    sketched = seen.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_LG_K))).alias("sites"))
    sketched = common.checkpointed(sketched.filter(F.col("sites") >= min_sites * (1 - band)))
    sure = sketched.filter(F.col("sites") > min_sites * (1 + band)).select("h")
    near = sketched.filter(F.col("sites") <= min_sites * (1 + band)).select("h")
    pairs = seen.groupBy("h", "site").agg(F.count("*").alias("n"))  # a hot line is a row for each of its sites from here on
    exact = pairs.join(near, "h").groupBy("h").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites).select("h")
    return sure.unionByName(exact)


def removals(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """(row, drop): the ordinals of the lines to remove from each row that loses any, ascending. The lines' hashes are
    stored, so that the texts are split once for the sketches, the exact counts and the join."""
    lines = common.stored(exploded(docs, site), "lines")
    found = common.checkpointed(lines.join(boilerplate(lines, min_sites), "h").select("row", "doc_id", "line_no", "h"))
    if keep_first:
        place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "row", "line_no")
        first = found.groupBy("h").agg(F.min(place).alias("first"))
        stays = first.select(F.col("first.row").alias("row"), F.col("first.line_no").alias("line_no"))
        found = found.join(stays, ["row", "line_no"], "left_anti")
    return found.groupBy("row").agg(F.array_sort(F.collect_set("line_no")).alias("drop"))


def without(parts: Column, drop: Column) -> Column:
    """The elements of an array but for those at some places (from 0, ascending): what stands between each two of them,
    so that the cost is that of both arrays' lengths and not of their product."""
    before = lambda j: F.coalesce(F.get(drop, j - 1), F.lit(-1))
    after = lambda j: F.coalesce(F.get(drop, j), F.size(parts))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), lambda j: F.slice(parts, before(j) + 2, after(j) - before(j) - 1)))


def clean(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """All columns of ``docs``, ``text`` without cross-site boilerplate, and n_lines, n_removed (longs).

    Null text stays null, with no lines; an empty text has none either. Rows that repeat keep one first occurrence
    between them if they differ; wholly equal rows (doc_id and text) are treated alike. A null site counts for no
    line's spread, but its text is cleaned. Columns called n_lines or n_removed are replaced; others stay, whatever their
    names. An empty table: no rows.
    """
    own = docs.drop("n_lines", "n_removed")
    found = removals(own.select("doc_id", "text", site), site, min_sites, keep_first).select(F.struct("row", "drop").alias("__cut_lines"))
    joined = own.join(found, F.xxhash64(own["doc_id"], own["text"]) == F.col("__cut_lines.row"), "left")
    parts, drop = F.split("text", "\n"), F.col("__cut_lines.drop")
    kept = F.concat_ws("\n", without(parts, drop))
    counted = F.size(F.filter(parts, lambda x: x.rlike(r"\S")))
    return joined.select(
        *[(F.when(drop.isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`")) for c in own.columns],
        F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(counted), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_removed"),
    )


#: The rule in SQL, for checks: exact counts, the first occurrence stays.
ORACLE_SQL = f"""
with split as (
  select doc_id, source, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
lines as (select doc_id, source, raw, line_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from split),
wide as (select line from lines where line <> '' group by line having count(distinct source) >= {MIN_SITES}),
marked as (
  select l.*, w.line is not null and row_number() over (partition by l.line order by l.doc_id, l.line_no) > 1 as gone
  from lines l left join wide w using (line)),
kept as (
  select doc_id, coalesce(string_agg(raw, chr(10) order by line_no) filter (where not gone), '') as text,
         count(*) filter (where line <> '') as n_lines, count(*) filter (where gone) as n_removed
  from marked group by doc_id)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_removed as bigint) as n_removed, cast(length(text) as bigint) as n_chars, sha256(text) as kept_sha256
from kept
"""
