"""A Spark data source over a statistics service, with filters pushed to the request.

Rows: dataset, dimension, member and value (JSON-stat text). The request's selections come from the
option ``where``, a JSON object of lists by dimension (a value, for names of options lose their
case), and from filters: ``dataset = / IN`` picks datasets, and ``dimension = 'geo' AND member =
/ IN ...`` adds members of one dimension. Spark checks all filters again, so each dataset gives a
row for each such member; without that filter it gives one row with both empty.

``method`` is get or post: a GET has the selections and ``since`` in its address, a POST sends a
query of items. ``fetch`` names a function (module:function) from (dataset, list of (dimension,
values)) to JSON-stat text, and ``folder`` a folder that executors can reach, with a file
<dataset>.json, so tests and mirrors need no network.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

TIMEOUT_S = 20


def http_get(url: str, timeout: float = TIMEOUT_S) -> str:
    """The body; any status but 2xx raises."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        if not 200 <= answer.status < 300:
            raise OSError(f"status {answer.status} from {url}")
        return answer.read().decode()


def http_post(url: str, body: dict, timeout: float = TIMEOUT_S) -> str:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        if not 200 <= answer.status < 300:
            raise OSError(f"status {answer.status} from {url}")
        return answer.read().decode()


def selection(filters: list[tuple[str, list[str]]]) -> dict:
    """The body that a table service takes for a list of (dimension, values)."""
    return {"query": [{"code": c, "selection": {"filter": "item", "values": v}} for c, v in filters], "response": {"format": "json-stat2"}}


class StatisticsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statistics"

    def schema(self) -> str:
        return "dataset string, dimension string, member string, value string"

    def reader(self, schema):
        return StatisticsReader(self.options)


class StatisticsReader(DataSourceReader):
    """One partition a dataset."""

    def __init__(self, options):
        self.options, self.asked, self.dimension, self.members = dict(options), [], "", []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            one, many = isinstance(f, EqualTo), isinstance(f, In)
            if (one or many) and f.attribute == ("dataset",):
                self.asked = [f.value] if one else list(f.value)
            elif one and f.attribute == ("dimension",):
                self.dimension = f.value
            elif (one or many) and f.attribute == ("member",):
                self.members = [f.value] if one else list(f.value)
            yield f  # Spark checks all of them again

    def partitions(self):
        named = [d.strip() for d in self.options.get("datasets", "").split(",") if d.strip()]
        return [InputPartition(d) for d in named if not self.asked or d in self.asked]

    def chosen(self) -> list[tuple[str, list[str]]]:
        """Selections of the option, then those of the filters."""
        out = {k: [str(x) for x in v] for k, v in json.loads(self.options.get("where", "{}")).items()}
        if self.dimension and self.members:
            out[self.dimension] = [str(m) for m in self.members]
        return list(out.items())

    def body(self, dataset: str) -> str:
        chosen = self.chosen()
        if fetch := self.options.get("fetch"):
            module, _, function = fetch.partition(":")
            return getattr(importlib.import_module(module), function)(dataset, chosen)
        if folder := self.options.get("folder"):
            with open(f"{folder}/{dataset}.json") as file:
                return file.read()
        url = f"{self.options['url'].rstrip('/')}/{dataset}"
        if self.options.get("method", "get").lower() == "post":
            return http_post(url, selection(chosen))
        since = [("sinceTimePeriod", self.options["since"])] if "since" in self.options else []
        return http_get(f"{url}?{urllib.parse.urlencode([('format', 'JSON'), *[(k, x) for k, v in chosen for x in v], *since])}")

    def read(self, partition) -> Iterator[tuple[str, str, str, str]]:
        body = self.body(partition.value)
        members = self.members if self.dimension and self.members else [""]
        for member in members:
            yield partition.value, self.dimension if member else "", str(member), body


def register(spark) -> None:
    """Makes the source known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StatisticsSource)
