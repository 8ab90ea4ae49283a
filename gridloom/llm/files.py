"""Archive files in the shared folder, by URI (file, hdfs, s3, gs), for tasks on any executor.

A task attempt writes files of its own, named by a random id, and reports them in its rows. Only rows of attempts that
succeeded reach the manifest, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO


def _at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def new_file(folder: str, suffix: str) -> tuple[str, BinaryIO]:
    """A new file's name in the folder and a stream to write it."""
    name = f"{uuid.uuid4().hex}{suffix}"
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    return name, system.open_output_stream(f"{path}/{name}", compression=None)


def open_file(folder: str, name: str) -> BinaryIO:
    """A random-access stream over a file of the folder."""
    system, path = _at(folder)
    return system.open_input_file(f"{path}/{name}")
