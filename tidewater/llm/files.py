"""Files in the folder that driver and executors share, through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def write_once(folder: str, name: str, data: bytes) -> str:
    """Writes folder/name-<unique> whole, under another name until it is complete; returns its path.

    Retried or speculative tasks write files of their own; only the one whose path a finished task
    reports is ever read.
    """
    system, at = open_fs(folder)
    system.create_dir(at, recursive=True)
    final = f"{at}/{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{final}.part") as out:
        out.write(data)
    system.move(f"{final}.part", final)
    return f"{folder.rstrip('/')}/{os.path.basename(final)}"


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file or of the files below a folder whose names have the suffix, in order."""
    system, at = open_fs(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((prefix + x.path, x.size) for x in found if x.is_file and suffix in os.path.basename(x.path) and not x.base_name.startswith((".", "_")) and not x.path.endswith(".part"))


def read_all(path: str) -> bytes:
    system, at = open_fs(path)
    with system.open_input_stream(at) as f:
        return f.read()
