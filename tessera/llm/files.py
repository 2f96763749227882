"""Files that tasks write to, and read from, the folder that driver and executors share."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system (local, HDFS, object stores) and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class NewFile:
    """A file that appears under its final name only when it is complete.

    Each attempt of a task writes a file of its own name; the manifest that the stage returns names
    the files that count, so what a lost or speculative attempt left behind is never read.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.path, self._final, self._part = f"{folder}/{name}", f"{base}/{name}", f"{base}/.{name}.part"
        self._out, self.size = self.fs.open_output_stream(self._part), 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()
        self.fs.move(self._part, self._final)


def open_input(path: str):
    fs, base = filesystem(path)
    return fs.open_input_file(base)
