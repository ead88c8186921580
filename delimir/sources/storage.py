"""Opening paths on the driver and in tasks: local files, and stores that pyarrow knows."""

from __future__ import annotations

import io
import os


def local_path(path: str) -> str | None:
    """The local form of a path, or None if it is in a store."""
    if path.startswith("file:"):
        rest = path[5:]
        return "/" + rest.lstrip("/")
    return path if "://" not in path else None


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def open_bytes(path: str) -> io.IOBase:
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    fs, p = _store(path)
    return fs.open_input_file(p)


def create_bytes(path: str):
    """A stream to a new file, for ``with``; folders on the way are made."""
    local = local_path(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    fs, p = _store(path)
    fs.create_dir(os.path.dirname(p), recursive=True)
    return fs.open_output_stream(p)


def move(path: str, to: str) -> None:
    local = local_path(path)
    if local is not None:
        os.replace(local, local_path(to))
    else:
        fs, p = _store(path)
        fs.move(p, _store(to)[1])


def size_of(path: str) -> int:
    local = local_path(path)
    if local is not None:
        return os.path.getsize(local)
    fs, p = _store(path)
    return fs.get_file_info(p).size


def files_of(path: str) -> list[str]:
    """The data files of a file, folder or local glob, by name; hidden ones and markers are left out."""
    local = local_path(path)
    if local is not None:
        import glob

        if os.path.isdir(local):
            found = [os.path.join(top, f) for top, dirs, names in os.walk(local) for f in names if not f.startswith((".", "_")) and not any(x.startswith((".", "_")) for x in os.path.relpath(top, local).split(os.sep) if x != ".")]
            return sorted(found)
        if os.path.exists(local):
            return [local]
        found = sorted(p for p in glob.glob(local) if os.path.isfile(p))
        if not found:
            raise FileNotFoundError(f"no such file: {path}")
        return found
    from pyarrow.fs import FileSelector, FileType

    fs, p = _store(path)
    info = fs.get_file_info(p)
    if info.type == FileType.Directory:
        scheme = path.split("://", 1)[0]
        return sorted(f"{scheme}://{x.path.lstrip('/')}" for x in fs.get_file_info(FileSelector(p, recursive=True)) if x.type == FileType.File and not x.base_name.startswith((".", "_")))
    return [path]


def chunks_of(stream, size: int, start: int = 0, end: int | None = None):
    """Byte strings of at most ``size`` from [start, end)."""
    with stream:
        if start:
            stream.seek(start)
        left = end - start if end is not None else None
        while left is None or left > 0:
            got = stream.read(size if left is None else min(size, left))
            if not got:
                return
            if left is not None:
                left -= len(got)
            yield got
