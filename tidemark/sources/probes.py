"""Health of sources: each is asked once, in a task, and what comes back is judged by its kind."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import has_envelope
from tidemark.sources.rest import http_get, http_post, selection

TIMEOUT_S = 8
ANSWER = "name string, kind string, required boolean, body string, error string, latency_ms long"


def ask(kind: str, url: str) -> str:
    """The body of a source; table services are asked by POST."""
    return http_post(url, selection([]), TIMEOUT_S) if kind == "pxweb" else http_get(url, TIMEOUT_S)


def answers(probes: DataFrame, fetch: str = "tidemark.sources.probes:ask") -> DataFrame:
    """body, error and latency_ms of each probe (name, kind, required, url). fetch names a
    function from (kind, url) to a body; what it raises becomes the error."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        module, _, function = fetch.partition(":")
        call = getattr(importlib.import_module(module), function)
        for batch in batches:
            rows = []
            for name, kind, required, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                began, body, error = time.monotonic(), None, None
                try:
                    body = call(kind, url)
                except Exception as failure:  # noqa: BLE001 - any failure is this probe's answer
                    error = str(failure) or type(failure).__name__
                rows.append((name, kind, required, body, error, int(1000 * (time.monotonic() - began))))
            names = ["name", "kind", "required", "body", "error", "latency_ms"]
            types = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    spread = probes.select("name", "kind", "required", "url").repartition(8, "name")  # one slow source must not hold up the rest
    return spread.mapInArrow(run, ANSWER)


def is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def judged(found: DataFrame) -> DataFrame:
    """name, status, required and error of answers: a body must be what its kind says."""
    fine = F.when(F.col("kind") == "xml", has_envelope(F.col("body"))).otherwise(is_json(F.col("body")))
    why = F.when(F.col("kind") == "xml", "missing required elements").otherwise("not JSON")
    error = F.coalesce("error", F.when(~F.coalesce(fine, F.lit(False)), why))
    return found.select("name", F.when(error.isNull(), "healthy").otherwise("unhealthy").alias("status"), "required", error.alias("error"))


def probes(spark: SparkSession, urls: dict[str, str], names: list[tuple[str, str, bool]]) -> DataFrame:
    """The probes that have an address."""
    rows = [(name, kind, required, urls[name]) for name, kind, required in names if name in urls]
    return spark.createDataFrame(rows, "name string, kind string, required boolean, url string")
