"""Files of a shared store, opened from any executor by URI."""

from __future__ import annotations

import re

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; file:/x and plain paths are local."""
    uri = re.sub(r"^file:/+", "/", uri)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def commit(path: str, names: list[str]) -> None:
    """Marks which files of a folder belong to it: files of lost or repeated attempts don't."""
    system, root = place(path)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/_committed", compression=None) as f:
        f.write("".join(f"{n}\n" for n in sorted(names)).encode())


def committed(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a folder's committed files."""
    system, root = place(path)
    with system.open_input_stream(f"{root}/_committed", compression=None) as f:
        names = f.read().decode().split("\n")[:-1]
    return [(n, system.get_file_info(f"{root}/{n}").size) for n in names]


def ranges(path: str, target: int) -> list[tuple[str, int, int, int]]:
    """(name, bytes, start, end): byte ranges of about `target` that cover the committed files."""
    return [(n, size, at, min(size, at + target)) for n, size in committed(path) for at in range(0, size, target)]


def read_at(uri: str, start: int, n: int) -> bytes:
    system, path = place(uri)
    with system.open_input_file(path) as f:
        return f.read_at(n, start)
