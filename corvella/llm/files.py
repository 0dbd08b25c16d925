"""Binary files in the shared folder, written and range-read by tasks through Arrow's file systems.

A task writes to a name of its own and reports it in its result row, so a repeated attempt never
touches the file of another, and files of lost attempts are simply not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri)


class Sink:
    """A new file under ``folder``; ``name`` is its full URI."""

    def __init__(self, folder: str, suffix: str):
        self.name = f"{folder}/{uuid.uuid4().hex}{suffix}"
        system, path = _at(self.name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self._out = system.open_output_stream(path, compression=None)
        self.position = 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset at which ``data`` starts."""
        at = self.position
        self._out.write(data)
        self.position += len(data)
        return at

    def close(self) -> None:
        self._out.close()


class Source:
    """Random access to one file."""

    def __init__(self, name: str):
        system, path = _at(name)
        self._file = system.open_input_file(path)
        self.size = self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)

    def close(self) -> None:
        self._file.close()


class Sources:
    """The last few files opened."""

    def __init__(self, most: int = 16):
        self.most, self.open = most, {}

    def __getitem__(self, name: str) -> Source:
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = Source(name)
        return self.open[name]

    def close(self) -> None:
        for s in self.open.values():
            s.close()
        self.open = {}


def chunks(items: list, size: int) -> Iterable[list]:
    for lo in range(0, len(items), size):
        yield items[lo : lo + size]
