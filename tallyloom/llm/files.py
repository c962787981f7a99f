"""Files that tasks write to and read from a shared folder, by URI.

A task writes below a name of its own attempt and returns the name; only names
that came back are read, so what a lost or repeated task left behind is ignored.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def _resolve(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def own_name(folder: str, stem: str, suffix: str) -> str:
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


@contextmanager
def writing(uri: str):
    system, path = _resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield out


@contextmanager
def reading(uri: str):
    system, path = _resolve(uri)
    with system.open_input_file(path) as source:
        yield source
