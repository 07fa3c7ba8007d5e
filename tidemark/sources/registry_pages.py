"""A Spark data source over a paged registry service.

Its schema is the reader's own (``.schema(...)``), and its columns are the fields that the service
is asked for. Filters ``column = x`` and ``column IN (...)`` go into the request, and Spark checks
them again. The service tells by a request for no rows how many there are; from that, partitions
are planned by offset, ``pages`` requests of ``page_size`` rows each, or more requests where that
would take over TASKS tasks.

Options: ``resource``; ``url`` of the service; ``q``, a text to search; ``sort`` (default _id: pages
need a stable order); ``page_size`` (default 1000); ``pages`` a task (default 10); ``limit``.
``fetch`` names a function (module:function) from a request's parameters to the answer's text, and
``folder`` a mirror of pages written by write_pages, so that neither needs a network. A mirror
answers with all rows of a page, whatever the filters; Spark's own check makes that right. It finds
a page by an index of its files, and a task reads a file once for all its pages.

Cases: a field that a record lacks is null, as is one that isn't of its type; an answer without
success raises; a service without rows gives an empty table of no partitions but one empty.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from tidemark.sources.rest import http_get
from tidemark.storage import store

PAGE_SIZE = 1000
PAGES = 10
#: At most so many tasks a scan; beyond it, a task asks for more pages.
TASKS = 256
#: Pages in a file of a mirror, and the name of its index.
FILE_PAGES = 100
INDEX = "index.json"


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _number(kind: type) -> Callable:
    def read(value):
        try:
            return None if value is None or isinstance(value, bool) else kind(value)
        except (TypeError, ValueError):
            return None

    return read


_READ = {StringType: _text, LongType: _number(int), DoubleType: _number(float), BooleanType: lambda v: v if isinstance(v, bool) else None}


class RegistrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        raise ValueError("name the fields to ask for with .schema(...)")

    def reader(self, schema: StructType) -> RegistryReader:
        return RegistryReader(self.options, schema)


class RegistryReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.schema = dict(options), schema
        odd = [f.name for f in schema if type(f.dataType) not in _READ]
        if odd:
            raise ValueError(f"fields are string, long, double or boolean: {odd}")
        self.size, self.filters, self.mirror = int(self.options.get("page_size", PAGE_SIZE)), {}, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1:
                asked = [f.value] if isinstance(f, EqualTo) else list(f.value)
                known = self.filters.get(f.attribute[0])
                self.filters[f.attribute[0]] = asked if known is None else [x for x in known if x in asked]
            yield f  # Spark checks all of them again

    def request(self, offset: int, limit: int) -> dict[str, str]:
        asked = {"resource_id": self.options.get("resource", ""), "offset": str(offset), "limit": str(limit), "sort": self.options.get("sort", "_id"), "fields": ",".join(self.schema.names)}
        if self.filters:
            asked["filters"] = json.dumps(self.filters, ensure_ascii=False)
        return asked | ({"q": self.options["q"]} if self.options.get("q") else {})

    def answer(self, offset: int, limit: int) -> dict:
        """records and total."""
        asked = self.request(offset, limit)
        if folder := self.options.get("folder"):
            self.mirror = self.mirror or Mirror(folder)
            return self.mirror.answer(offset, limit)
        if fetch := self.options.get("fetch"):
            module, _, function = fetch.partition(":")
            body = getattr(importlib.import_module(module), function)(asked)
        else:
            body = http_get(f"{self.options['url'].rstrip('/')}/datastore_search?{urllib.parse.urlencode(asked)}")
        said = json.loads(body)
        if said.get("success") is False or "result" not in said:
            raise OSError(f"the registry answered without a result: {body[:200]}")
        return said["result"]

    def total(self) -> int:
        there = int(self.answer(0, 0).get("total", 0))
        return min(there, int(self.options["limit"])) if "limit" in self.options else there

    def partitions(self) -> list[InputPartition]:
        total = self.total()
        step = self.size * max(int(self.options.get("pages", PAGES)), -(-total // (self.size * TASKS)))
        return [InputPartition((at, min(total, at + step))) for at in range(0, total, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, end = partition.value
        readers = [(f.name, _READ[type(f.dataType)]) for f in self.schema]
        while at < end:
            asked = min(self.size, end - at)
            records = self.answer(at, asked).get("records", [])
            for record in records:
                yield tuple(read(record.get(name)) for name, read in readers)
            at += asked


def total(options: dict[str, str], filters: dict[str, list] | None = None) -> int:
    """How many rows the service has, without reading any."""
    reader = RegistryReader(options, StructType())
    reader.filters = filters or {}
    return reader.total()


def write_pages(rows: DataFrame, folder: str, place: Column, size: int = PAGE_SIZE) -> None:
    """A mirror: rows in order of place, as JSON texts in files of FILE_PAGES pages each, and an
    index of the files by their first row. place may have gaps; nulls come first."""
    # a row's own column may be called as the place is, so it goes into the text first
    lines = rows.select(place.alias("place"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    # at rises through all partitions, with gaps between them
    placed = lines.repartitionByRange("place").sortWithinPartitions("place").select(F.monotonically_increasing_id().alias("at"), "value")
    placed.write.option("maxRecordsPerFile", FILE_PAGES * size).parquet(f"{folder}/rows")
    found = rows.sparkSession.read.schema("at long").parquet(f"{folder}/rows").groupBy(F.col("_metadata.file_name")).agg(F.min("at").alias("at"), F.count("*").alias("n")).orderBy("at").collect()  # a row a file
    first = list(accumulate((r.n for r in found), initial=0))
    files, root = store(folder)
    with files.open_output_stream(f"{root}/{INDEX}") as stream:
        stream.write(json.dumps({"files": [r.file_name for r in found], "first": first[:-1], "total": first[-1]}).encode())


class Mirror:
    """The files of a mirror, by offset; the last one that was opened is kept."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.root = store(folder)
        self.opened, self.lines = -1, None
        index = {"files": [], "first": [], "total": 0}
        if self.store.get_file_info(f"{self.root}/{INDEX}").type != fs.FileType.NotFound:
            with self.store.open_input_stream(f"{self.root}/{INDEX}") as stream:
                index = json.loads(stream.read())
        self.files, self.first, self.total = index["files"], index["first"], index["total"]

    def _texts(self, at: int, begin: int, end: int) -> list[str]:
        from pyarrow import parquet

        if at != self.opened:
            self.lines = parquet.read_table(f"{self.root}/rows/{self.files[at]}", columns=["value"], filesystem=self.store, partitioning=None)["value"]
            self.opened = at
        return self.lines[begin:end].to_pylist()

    def answer(self, offset: int, limit: int) -> dict:
        """records and total."""
        end, lines = min(offset + limit, self.total), []
        while offset < end:
            at = bisect_right(self.first, offset) - 1
            found = self._texts(at, offset - self.first[at], end - self.first[at])
            lines += found
            offset += len(found)
        return {"records": json.loads(f"[{','.join(lines)}]"), "total": self.total}


def register(spark: SparkSession) -> None:
    """Makes the source known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegistrySource)


def read(spark: SparkSession, schema: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("registry").schema(schema).options(**options).load()
