"""Files in any store that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from ..session import is_local, shared_dir


def checked_folder(spark: SparkSession, folder: str) -> str:
    """The path, if all machines of the session can be expected to see it: a plain one must lie in the shared folder."""
    plain = "://" not in folder and not folder.startswith("file:")
    shared = shared_dir(spark).removeprefix("file:")
    if plain and not is_local(spark) and not folder.startswith("/" + shared.lstrip("/")):
        raise ValueError(f"{folder} may be another folder on every machine; name one below spark.checkpoint.dir, or a URI")
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """pyarrow's file system and path for a URI or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
