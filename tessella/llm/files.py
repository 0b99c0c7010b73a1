"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def open_output(folder: str, name: str, suffix: str):
    """A new file in ``folder``; returns its path and stream.

    Each attempt of a task writes a file of its own. Only files that a committed manifest lists are read, so what a
    lost or doubled attempt left is never seen.
    """
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    file = f"{name}-{uuid.uuid4().hex[:12]}{suffix}"
    return f"{folder}/{file}", fs.open_output_stream(f"{base}/{file}", compression=None)


def open_input(path: str):
    fs, base = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(base)
