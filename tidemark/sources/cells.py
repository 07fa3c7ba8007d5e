"""A Spark data source of a statistics service's cells, with periods and members in the request.

Rows: dataset, value, and a column for every dimension named in the reader's schema (default geo
and time). Datasets come from the option ``datasets``. ``dataset``, and any dimension, taken by
= or IN go into the request; a lower bound of ``time`` becomes its first period, an upper bound
its last. Each asked dataset is a partition, or each asked member of ``split`` (default geo) of
each of them, so that one long table is read by several tasks. Spark checks all filters again.

A cell's coordinates are read off its flat place by the sizes of the dimensions (mixed radix), so
dimensions may be many and in any order; cells without a value aren't rows.

Options besides: ``where``, ``method``, ``url``, ``fetch`` and ``folder`` as the statistics source
has them; a folder has <dataset>.json, or a folder dataset=<dataset> of text files. ``fetch`` gets
the dataset and the list of (dimension, values), with first and last periods among them under
sinceTimePeriod and untilTimePeriod.

Cases: a dimension of the schema that a dataset lacks is null; a dataset that isn't a cube has no
rows; a category without an index takes the order of its labels.
"""

from __future__ import annotations

import importlib
import json
import math
import urllib.parse
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidemark.sources.rest import http_get, http_post, selection
from tidemark.storage import store, texts_in


def categories(cube: dict, dimension: str) -> list[str]:
    """The keys of a dimension in order of their places."""
    category = cube["dimension"][dimension]["category"]
    index = category.get("index")
    if isinstance(index, dict):
        return sorted(index, key=index.get)
    return list(index if index is not None else category.get("label", {}))


def cells(cube: dict) -> Iterator[tuple[dict[str, str], float]]:
    """(coordinates, value) of each cell that has one, dense or sparse."""
    if not all(k in cube for k in ("id", "size", "dimension", "value")):
        return
    names, sizes = cube["id"], cube["size"]
    keys = [categories(cube, d) for d in names]
    strides = [math.prod(sizes[k + 1 :]) for k in range(len(sizes))]
    values = cube["value"]
    placed = ((int(k), v) for k, v in values.items()) if isinstance(values, dict) else enumerate(values)
    for at, value in placed:
        if value is not None and at < math.prod(sizes):
            yield {d: own[at // stride % size] for d, own, stride, size in zip(names, keys, strides, sizes, strict=True)}, float(value)


class CellsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statistics_cells"

    def schema(self) -> str:
        return "dataset string, geo string, time string, value double"

    def reader(self, schema: StructType) -> CellsReader:
        return CellsReader(self.options, schema)


class CellsReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.names = dict(options), schema.names
        self.members: dict[str, list[str]] = {}
        self.since = self.until = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo | In) and name and name != "value":
                asked = [f.value] if isinstance(f, EqualTo) else list(f.value)
                known = self.members.get(name)
                self.members[name] = asked if known is None else [x for x in known if x in asked]
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and name == "time":
                self.since = max(filter(None, (self.since, f.value)))
            elif isinstance(f, LessThan | LessThanOrEqual) and name == "time":
                self.until = min(filter(None, (self.until, f.value)))
            yield f  # Spark checks all of them again

    def partitions(self) -> list[InputPartition]:
        named = [d.strip() for d in self.options.get("datasets", "").split(",") if d.strip()]
        asked = [d for d in named if "dataset" not in self.members or d in self.members["dataset"]]
        split = self.options.get("split", "geo")
        each = self.members.get(split, [None])
        return [InputPartition((d, split, m)) for d in asked for m in each] or [InputPartition((None, split, None))]

    def chosen(self, split: str, member: str | None) -> list[tuple[str, list[str]]]:
        """Selections of the option, then those of the filters."""
        out = {k: [str(x) for x in v] for k, v in json.loads(self.options.get("where", "{}")).items()}
        out |= {d: [str(m) for m in members] for d, members in self.members.items() if d != "dataset"}
        if member is not None:
            out[split] = [member]
        return [*out.items(), *((k, [v]) for k, v in (("sinceTimePeriod", self.since), ("untilTimePeriod", self.until)) if v)]

    def body(self, dataset: str, chosen: list[tuple[str, list[str]]]) -> str:
        if fetch := self.options.get("fetch"):
            module, _, function = fetch.partition(":")
            return getattr(importlib.import_module(module), function)(dataset, chosen)
        if folder := self.options.get("folder"):
            files, root = store(folder)
            if files.get_file_info(f"{root}/{dataset}.json").is_file:
                with files.open_input_stream(f"{root}/{dataset}.json") as stream:
                    return stream.read().decode()
            return "".join(texts_in(f"{folder}/dataset={dataset}"))
        url = f"{self.options['url'].rstrip('/')}/{dataset}"
        if self.options.get("method", "get").lower() == "post":
            return http_post(url, selection([c for c in chosen if not c[0].endswith("TimePeriod")]))
        return http_get(f"{url}?{urllib.parse.urlencode([('format', 'JSON'), *[(k, x) for k, v in chosen for x in v]])}")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        dataset, split, member = partition.value
        if dataset is None:
            return
        try:
            cube = json.loads(self.body(dataset, self.chosen(split, member)))
        except json.JSONDecodeError:
            return
        for at, value in cells(cube if isinstance(cube, dict) else {}):
            if member is None or at.get(split) == member:
                own = at | {"dataset": dataset, "value": value}
                yield tuple(own.get(name) for name in self.names)


def read(spark: SparkSession, schema: str | None = None, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CellsSource)
    reader = spark.read.format("statistics_cells").options(**options)
    return (reader.schema(schema) if schema else reader).load()
