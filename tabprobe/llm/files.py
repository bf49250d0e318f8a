"""Files written by tasks into shared folders, by path or URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_write(path: str):
    """A binary stream for a new file; folders are made."""
    system, name = _at(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name, compression=None)


def open_read(path: str):
    """A seekable binary file."""
    system, name = _at(path)
    return system.open_input_file(name)


def put_file(path: str, data) -> None:
    """Writes a whole file under another name and then gives it its own, so that no reader sees a part of it."""
    system, name = _at(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as out:
        out.write(data)
    system.move(draft, name)
