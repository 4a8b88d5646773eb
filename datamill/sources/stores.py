"""Files of a folder in any store that pyarrow opens, for the Python data sources."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder (a path or a URI) and the folder's path in it."""
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


def listed(folder: str) -> list[tuple[str, int]]:
    """(path below the folder, size) of all files, in order of path; hidden and unfinished ones are left out."""
    store, root = opened(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    below = ((f.path[len(root) + 1 :], f.size or 0) for f in found if f.type == fs.FileType.File)
    return sorted((p, n) for p, n in below if not any(part.startswith((".", "_")) for part in p.split("/")))


def blocks(files: list[tuple[str, int]], most_files: int, most_bytes: int) -> Iterator[list[str]]:
    """Consecutive files, as many and as large as a task should read; a larger file is a block by itself."""
    held: list[str] = []
    size = 0
    for path, n in files:
        if held and (len(held) == most_files or size + n > most_bytes):
            yield held
            held, size = [], 0
        held.append(path)
        size += n
    if held:
        yield held


def put(store: fs.FileSystem, path: str, write) -> None:
    """Write a file under a name of its own and give it its name when it is whole; doing it again gives the same file."""
    folder, name = posixpath.split(path)
    store.create_dir(folder, recursive=True)
    unfinished = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(unfinished) as out:
        write(out)
    store.move(unfinished, path)
