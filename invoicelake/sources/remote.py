"""Files as Python code on executors reads and writes them: any store that a URI names, through Arrow's file systems."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path or path.startswith("file:"):
        uri = path if "://" in path else "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), posixpath.abspath(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder, by path; names with a leading dot or underscore are left out, as Spark does."""
    store, root = located(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    shown = lambda p: not any(part[:1] in "._" for part in p[len(root) :].split("/") if part)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and shown(f.path))


def read(path: str, store: fs.FileSystem | None = None) -> bytes:
    if store is None:
        store, path = located(path)
    with store.open_input_stream(path) as f:
        return f.read()


def write(path: str, content: bytes) -> None:
    """The file is there whole or not at all: a name of its own first, then the right one, which replaces an earlier file."""
    store, target = located(path)
    folder, name = posixpath.split(target)
    store.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(content)
    store.move(own, target)


def delete_folder(path: str) -> None:
    store, root = located(path)
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)
