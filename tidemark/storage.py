"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where that setting is missing, a
    local session gets a temporary one, as in tests, and a cluster an error, before any work."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not set_dir and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="tidemark-"))
    return set_dir or context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def store(path: str):
    """(Arrow filesystem, path within) for tasks and data sources that open files themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def texts_in(folder: str) -> list[str]:
    """The texts of a folder's data files, in order of their names; none if it isn't there."""
    from pyarrow import fs

    files, root = store(folder)
    found = sorted((f for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
    out = []
    for f in found:
        with files.open_input_stream(f.path) as stream:
            out.append(stream.read().decode())
    return out
