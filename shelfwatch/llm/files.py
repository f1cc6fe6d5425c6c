"""Files that tasks write into the shared folder, named by URI and opened with pyarrow's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, GroupedData


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, stem: str, suffix: str):
    """A new file below `folder`, as (uri, stream).

    The name is unique to the attempt: a task that runs again writes another file, and
    only the one named in the committed rows of the task is ever read.
    """
    store, path = resolve(folder)
    store.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield f"{folder.rstrip('/')}/{name}", out


def open_random(uri: str):
    """A seekable reader of a file."""
    store, path = resolve(uri)
    return store.open_input_file(path)


def by_file(index: DataFrame, path: str = "path") -> GroupedData:
    """An index grouped by file, in as many partitions as there are files.

    The rows are narrow but reading a file is not, so they are not merged by their own size.
    """
    files = index.select(path).distinct().count()
    return index.repartition(max(1, files), path).groupBy(path)
