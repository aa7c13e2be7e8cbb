"""Landed pages as a data source: ``spark.read.format("landed_pages").load(folder)``.

A folder of page files, one for each page, in sub-folders that say what the page was asked
for: ``kind=<kind>/respondent=<code>/first=<hour>/last=<hour>/``. The source has one partition
for each file and the columns ``kind, respondent, first_hour, last_hour, source_file, body``.
Predicates on the first four (equality, ``IN``, comparisons) are pushed down and answered
from the folder names: files that cannot match are neither opened nor planned. That is the
request to the paged API - respondent, type facet, hour range - put to the files; bodies are
parsed by :mod:`voltframe.sources.landed_pages` like any other pages.

Folders may be on any file system that Arrow opens by URI (local, HDFS, S3, GCS). Filter
pushdown of Python sources has to be enabled, which :func:`register` does.

Hours are texts ``YYYY-MM-DDTHH``, which compare as times do. Pages without any period have
the hours ``none`` and match no hour predicate; a null respondent is
``__HIVE_DEFAULT_PARTITION__``. An empty folder has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from voltframe.sources.facts import select_range
from voltframe.sources.landed_pages import parse_pages

NAME = "landed_pages"
SCHEMA = "kind string, respondent string, first_hour string, last_hour string, source_file string, body string"
FOLDERS = {"kind": "kind", "respondent": "respondent", "first": "first_hour", "last": "last_hour"}
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"
NO_HOUR = "none"
COMPARE = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


@dataclass
class PageFile(InputPartition):
    """One page file and what its folders say."""

    path: str
    values: tuple[str | None, ...]  # kind, respondent, first_hour, last_hour


class PageReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.filters: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in COMPARE and len(f.attribute) == 1 and f.attribute[0] in FOLDERS.values():
                self.filters.append((f.attribute[0], f))
            else:
                yield f

    def partitions(self) -> list[PageFile]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.type != fs.FileType.File or name.startswith(("_", ".")):
                continue
            parts = dict(p.split("=", 1) for p in info.path[len(root):].split("/") if "=" in p)
            value = {FOLDERS[k]: None if v in (NULL_NAME, NO_HOUR) else unquote(v) for k, v in parts.items() if k in FOLDERS}
            if all(value.get(column) is not None and COMPARE[type(f)](value[column], f.value) for column, f in self.filters):
                found.append(PageFile(info.path, tuple(value.get(c) for c in FOLDERS.values())))
        return sorted(found, key=lambda p: p.path)

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.path) as stream:
            body = stream.read().decode("utf-8", "replace").removesuffix("\n")
        row = [*partition.values, partition.path.rsplit("/", 1)[-1], body]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=[c.split()[0] for c in SCHEMA.split(", ")])


class LandedPages(DataSource):
    """The data source; its one option is the folder (``load(folder)``)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        path = self.options["path"]
        return PageReader(path if "://" in path or path.startswith("file:") else f"file://{path}")


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let its filters be pushed down."""
    spark.dataSource.register(LandedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_page_files(pages: DataFrame, path: str, kind: str) -> None:
    """Land pages (``respondent, body``), each as a file of its own in the folders of what it holds.

    The hours are the least and greatest period of the page's records."""
    texts = F.try_variant_get(F.try_parse_json("body"), "$.response.data", "array<variant>")
    period = F.transform(F.coalesce(texts, F.array()), lambda e: F.try_variant_get(e, "$.period", "string"))
    hours = F.transform(F.filter(period, lambda p: p.rlike(r"^\d{4}-\d{2}-\d{2}")), lambda p: F.rpad(F.substring(p, 1, 13), 13, "T00"))
    named = pages.select(
        F.lit(kind).alias("kind"), "respondent", F.coalesce(F.array_min(hours), F.lit(NO_HOUR)).alias("first"),
        F.coalesce(F.array_max(hours), F.lit(NO_HOUR)).alias("last"), F.regexp_replace("body", r"\n", " ").alias("value"))
    named.write.mode("append").option("maxRecordsPerFile", 1).partitionBy("kind", "respondent", "first", "last").text(path)


def read_range(spark: SparkSession, path: str, region: str, start: str, end: str, kind: str = "generation", types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts of a region from ``start`` to the end of day ``end`` and the rejects of the pages read: only files
    of pages that can hold such facts are opened."""
    pages = spark.read.format(NAME).load(path).where(
        (F.col("kind") == kind) & (F.col("respondent") == region) & (F.col("first_hour") <= f"{end}T23") & (F.col("last_hour") >= f"{start}T00"))
    good, rejects = parse_pages(pages.select("source_file", "body"), kind)
    return select_range(good, region, start, end, types, sort=False), rejects
