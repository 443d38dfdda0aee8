"""Plain files in the shared folder, from the driver and from tasks, wherever that folder is (``pyarrow.fs``)."""

from __future__ import annotations

import uuid

import numpy as np


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = _open(uri)
    system.create_dir(path, recursive=True)


def write_file(uri: str, pieces) -> None:
    """All pieces under a name of this attempt's own, then moved: a repeated task leaves one whole file."""
    system, path = _open(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        for piece in pieces:
            out.write(piece)
    system.move(own, path)


def read_array(uri: str, kind: str, start: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` values from value ``start`` on: memory-mapped where the folder is a mounted one, else read."""
    from pyarrow import fs

    system, path = _open(uri)
    size = np.dtype(kind).itemsize
    if count is None:
        count = system.get_file_info(path).size // size - start
    if not count:
        return np.zeros(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r", start * size, (count,))
    with system.open_input_file(path) as file:
        file.seek(start * size)
        return np.frombuffer(file.read(count * size), kind)
