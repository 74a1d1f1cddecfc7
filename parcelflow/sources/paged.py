"""Extracts in pages: JSON lines in the order of the key, beside an index with the ends of each page.

``write_pages`` publishes an extract as pages; ``read_pages`` reads one published extract as a data source whose tasks take
ranges of pages, that is ranges of keys. Comparisons on the key and on the permit date are pushed into it: pages whose ends
exclude a match are not opened, rows are tested before they leave the reader. A page that is not what its index says stops
the run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, json, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import snapshot
from .permits import Dataset, raw_schema, schema_fingerprint

PAGE_ROWS = 50_000
#: Pages that one task reads, and rows of one file of the index.
TASK_PAGES, INDEX_ROWS = 8, 4_096
NAME = "permit_pages"
_TESTS = {
    ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal,
}


def date_column(dataset: Dataset) -> str:
    return "permit_date" if dataset.name == "development" else "issue_date"


def write_pages(raw: DataFrame, dataset: Dataset, root: str, revision: str, page_rows: int = PAGE_ROWS, index_rows: int = INDEX_ROWS) -> int:
    """Publish an extract as pages of ``page_rows`` rows at most, below ``root``; the number of its manifest. Rows are
    dealt by ranges of the key, so that pages follow one another in its order; rows without a key come first. Equal keys
    may lie on two pages."""
    spark, key, day = raw.sparkSession, dataset.key, date_column(dataset)
    folder, names = f"v-{uuid.uuid4().hex}", raw_schema(dataset).names
    own = raw.select(*[(F.col(f"`{n}`") if n in raw.columns else F.lit(None)).cast("string").alias(n) for n in names])
    number, _ = snapshot.newest(spark, root)
    placed = own.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    placed.write.option("maxRecordsPerFile", page_rows).option("ignoreNullFields", "true").json(f"{root}/{folder}/pages")
    ends = StructType([StructField(n, StringType()) for n in (key, day)])
    pages = spark.read.schema(ends).json(f"{root}/{folder}/pages").groupBy(F.col("_metadata.file_name").alias("page"))
    both = [f(n).alias(f"{e}_{k}") for k, n in (("key", key), ("day", day)) for e, f in (("first", F.min), ("last", F.max))]
    index = pages.agg(F.count("*").alias("rows"), *both).repartitionByRange("first_key", "page").sortWithinPartitions("first_key", "page")
    index.write.option("maxRecordsPerFile", index_rows).parquet(f"{root}/{folder}/index")
    rows = spark.read.parquet(f"{root}/{folder}/index").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    found = snapshot.Checkpoint(dataset.name, dataset.dataset_id, revision, schema_fingerprint(own), rows)
    snapshot.commit(spark, root, number + 1, {"version": folder, "checkpoint": asdict(found)})
    return number + 1


def announced(spark: SparkSession, root: str, number: int | None = None) -> snapshot.Checkpoint:
    """What the newest published extract, or one manifest's, says of itself: revision, columns and rows."""
    own = snapshot.manifest(spark, root, number)
    if own is None:
        raise FileNotFoundError(f"no extract in {root}")
    return snapshot.Checkpoint(**own["checkpoint"])


def read_pages(spark: SparkSession, dataset: Dataset, root: str, number: int | None = None, columns: list[str] | None = None, task_pages: int = TASK_PAGES) -> DataFrame:
    """The raw rows of one extract (the newest, or a manifest's), all columns or ``columns``. The folder is settled here:
    what is published later does not change what this frame reads."""
    own = snapshot.manifest(spark, root, number)
    if own is None:
        raise FileNotFoundError(f"no extract in {root}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PermitPages)
    schema = raw_schema(dataset)
    if columns:
        schema = StructType([schema[n] for n in columns])
    options = {"folder": f"{root}/{own['version']}", "key": dataset.key, "day": date_column(dataset), "task_pages": str(task_pages)}
    return spark.read.format(NAME).schema(schema).options(**options).load()


def stable_rows(spark: SparkSession, dataset: Dataset, root: str, **options) -> DataFrame:
    """``read_pages`` of the newest extract, whole, once its rows are as many as announced and no other extract has been
    published meanwhile; else UnstableSnapshot. Costs one pass over the key."""
    before = announced(spark, root)
    number = snapshot.newest(spark, root)[1]["number"]
    rows = read_pages(spark, dataset, root, number, [dataset.key]).count()
    snapshot.require_stable(before, announced(spark, root), rows)
    return read_pages(spark, dataset, root, number, **options)


@dataclass(frozen=True)
class PageRange(ds.InputPartition):
    """Rows ``start`` to ``stop`` of one file of the index."""

    index: str
    start: int
    stop: int


class PermitPages(ds.DataSource):
    """The source behind ``read_pages``; options: folder, key, day, task_pages."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)


class PageReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder = schema, options["folder"]
        self.named = {options["key"]: "key", options["day"]: "day"}
        self.task_pages, self.filters = int(options["task_pages"]), []

    def pushFilters(self, filters: list) -> Iterable:
        """Comparisons of the key or the day with a text are done here, and that they are not null; Spark does the rest."""
        for f in filters:
            ours = len(f.attribute) == 1 and f.attribute[0] in self.named if hasattr(f, "attribute") else False
            if ours and (isinstance(f, ds.IsNotNull) or (type(f) in _TESTS and isinstance(f.value, str))):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[PageRange]:
        """Ranges of the index's rows. Only the sizes in the footers of its files are read here."""
        system, path = fs.FileSystem.from_uri(self.folder)
        found = []
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{path}/index")) if f.path.endswith(".parquet"))
        for name in files:
            with system.open_input_file(name) as file:
                rows = parquet.read_metadata(file).num_rows
            found += [PageRange(name, i, min(i + self.task_pages, rows)) for i in range(0, rows, self.task_pages)]
        return found or [PageRange("", 0, 0)]

    def may_match(self, page: dict) -> bool:
        """Whether the ends of a page's columns leave room for a row that passes every filter."""
        for f in self.filters:
            first, last = (page[f"{end}_{self.named[f.attribute[0]]}"] for end in ("first", "last"))
            if first is None:  # nothing but nulls
                return False
            above, below = isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)), isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo))
            strict = isinstance(f, (ds.GreaterThan, ds.LessThan))
            if above and (last < f.value or (strict and last == f.value)) or below and (first > f.value or (strict and first == f.value)):
                return False
        return True

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        if not partition.index:
            return
        system, path = fs.FileSystem.from_uri(self.folder)
        with system.open_input_file(partition.index) as file:
            pages = parquet.read_table(file).slice(partition.start, partition.stop - partition.start).to_pylist()
        names = self.schema.names
        asked = pa.schema([(n, pa.string()) for n in dict.fromkeys([*names, *(f.attribute[0] for f in self.filters)])])
        how = json.ParseOptions(explicit_schema=asked, unexpected_field_behavior="ignore")
        for page in filter(self.may_match, pages):
            with system.open_input_stream(f"{path}/pages/{page['page']}") as stream:
                rows = json.read_json(stream, parse_options=how, read_options=json.ReadOptions(block_size=32 << 20))
            if rows.num_rows != page["rows"]:
                raise snapshot.UnstableSnapshot(f"{page['page']}: {rows.num_rows} rows, {page['rows']} announced")
            for f in self.filters:
                values = rows.column(f.attribute[0])
                rows = rows.filter(pc.is_valid(values) if isinstance(f, ds.IsNotNull) else _TESTS[type(f)](values, f.value))
            yield from rows.select(names).to_batches(max_chunksize=10_000)
