"""Files of other formats in the shared folder, by URI, from the driver or an executor."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, gs ... as pyarrow was built)."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def new_file(folder: str, stem: str, suffix: str):
    """Yields (sink, uri); the name is new for every attempt of a task, so that a lost or
    repeated attempt leaves a file that no manifest names. The file shows up under its name only when whole."""
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    system, path = at(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.part"
    sink = system.open_output_stream(part)
    try:
        yield sink, f"{folder}/{name}"
        sink.close()
    except BaseException:  # a task that fails or is killed leaves nothing behind
        sink.close()
        system.delete_file(part)
        raise
    system.move(part, f"{path}/{name}")


def open_random(uri: str):
    """A file for random access; memory-mapped where it is local, so that reads copy nothing."""
    system, path = at(uri)
    if isinstance(system, fs.LocalFileSystem) and os.path.getsize(path):
        import pyarrow as pa

        return pa.memory_map(path)
    return system.open_input_file(path)


def open_stream(uri: str):
    """A file for reading from the front, undecoded."""
    system, path = at(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)
