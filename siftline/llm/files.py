"""Files that tasks write into a shared folder: under a temporary name first, then renamed, so that a lost or
repeated task leaves the same files as one that ran once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator


def store(path: str):
    """pyarrow's file system for a path or URI, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Commit:
    """An output stream to a temporary name; commit() gives the file its final one."""

    def __init__(self, path: str):
        self.fs, self.path = store(path)
        folder = self.path.rpartition("/")[0]
        self.fs.create_dir(folder, recursive=True)
        self.temp = f"{folder}/.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.size, self.open = 0, True

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> int:
        self.out.close()
        self.fs.move(self.temp, self.path)
        self.open = False
        return self.size

    def abort(self) -> None:
        """Removes the temporary file, if there is one."""
        if self.open:
            self.open = False
            self.out.close()
            self.fs.delete_file(self.temp)


def cleaning(write: Callable[[Iterable, list[Commit]], Iterator]) -> Callable[[Iterable], Iterator]:
    """A task of write(batches, opened), whose temporary files go when it fails or is stopped."""

    def run(batches: Iterable) -> Iterator:
        opened: list[Commit] = []
        try:
            yield from write(batches, opened)
        finally:
            for file in opened:
                file.abort()

    return run
