"""Objects as tasks reach them: a file system and a path for each Hadoop URI.

Spark names objects by URIs whose paths are not percent-encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

from pyarrow import fs

URI = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)?$", re.DOTALL)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    parts = URI.match(path)
    if parts is None or parts[1].lower() == "file":
        return fs.LocalFileSystem(), parts[3] if parts else path
    scheme, authority, below = parts[1], parts[2] or "", parts[3] or "/"
    system, base = fs.FileSystem.from_uri(f"{scheme}://{quote(authority, safe='@:.-_')}/")
    return system, base.rstrip("/") + below


def content_of(path: str) -> bytes | None:
    """The bytes of an object, or None if it is gone."""
    system, inside = located(path)
    try:
        with system.open_input_stream(inside) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


def listed(root: str) -> Iterator[tuple[int, str, int]]:
    """Time in microseconds, name below `root`, and length of all objects; none if there is no such folder."""
    system, inside = located(root.rstrip("/"))
    found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True, recursive=True))
    for info in found:
        if info.type == fs.FileType.File:
            name = info.path.removeprefix(inside).lstrip("/")
            if not any(part[:1] in ("_", ".") for part in name.split("/")):  # as Spark's readers do
                yield info.mtime_ns // 1000, name, info.size
