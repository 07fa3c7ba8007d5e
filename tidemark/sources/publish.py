"""A sink that publishes at commit: readers see the rows of one whole run, or those of the run before.

Tasks write Parquet files into a folder of the run. Only as the job commits is the run named as the
current one, stamped with its key, the time, and how long it may be kept; if the job fails, its
files go and what was current stays. Files of tasks that ran twice, were given up, or still wrote
while the job failed aren't named, so they're never read; ``remove_old`` deletes them too.

Cases: a run without rows publishes an empty result with the columns; what was never published
raises on reading; columns may have any names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources.snapshots import MINUTES, OTHER_MINUTES
from tidemark.storage import store

CURRENT = "_current.json"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class PublishedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published"

    def schema(self) -> str:
        raise ValueError("read with publish.read")

    def writer(self, schema: StructType, overwrite: bool) -> PublishedWriter:
        return PublishedWriter(dict(self.options), schema)


class PublishedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.key, self.run = options["path"].rstrip("/"), options.get("key", ""), uuid.uuid4().hex
        self.columns = schema.json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, name, rows = None, f"part-{uuid.uuid4().hex}.parquet", 0
        files, root = store(f"{self.path}/run={self.run}")
        for batch in iterator:
            if out is None:
                files.create_dir(root, recursive=True)
                out = pq.ParquetWriter(files.open_output_stream(f"{root}/{name}"), batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        found = [m for m in messages if m is not None and m.name]
        minutes = next((m for start, m in MINUTES if self.key.startswith(start)), OTHER_MINUTES)
        said = {"run": self.run, "key": self.key, "fetchedAt": time.time(), "maxAge": 60 * minutes, "rows": sum(m.rows for m in found), "files": [m.name for m in found], "columns": self.columns}
        files, root = store(self.path)
        files.create_dir(root, recursive=True)
        new = f"{root}/_{self.run}.json"
        with files.open_output_stream(new) as out:
            out.write(json.dumps(said).encode())
        files.move(new, f"{root}/{CURRENT}")  # at once: readers find the old one or the new one

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = store(f"{self.path}/run={self.run}")
        if files.get_file_info(root).type != fs.FileType.NotFound:
            files.delete_dir(root)


def publish(rows: DataFrame, path: str, key: str) -> None:
    rows.sparkSession.dataSource.register(PublishedSink)
    rows.write.format("published").mode("append").options(path=path, key=key).save()


def stamp(path: str) -> dict:
    """What is said of the current run."""
    files, root = store(path)
    with files.open_input_stream(f"{root}/{CURRENT}") as found:
        return json.loads(found.read())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current run."""
    said = stamp(path)
    schema = StructType.fromJson(json.loads(said["columns"]))
    if not said["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/run={said['run']}/{name}" for name in said["files"]])


def is_fresh(path: str, now: float | None = None) -> bool:
    said = stamp(path)
    return (time.time() if now is None else now) - said["fetchedAt"] < said["maxAge"]


def remove_old(path: str) -> int:
    """Deletes the runs that aren't current; how many they were. Not while one is being written."""
    from pyarrow import fs

    current, (files, root) = stamp(path)["run"], store(path)
    old = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("run=") and f.base_name != f"run={current}"]
    for folder in old:
        files.delete_dir(folder)
    return len(old)
