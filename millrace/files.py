"""Files that Python reads and writes on any file system that pyarrow knows: local paths, ``file:``, ``hdfs:``, ``s3:`` and others."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def fresh_file(folder: str, part: int, suffix: str) -> str:
    """A name that no other attempt of this or another task writes to. Readers go by the manifest of the attempts that count."""
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """An output stream; the folder is made where the store has folders."""
    system, path = open_fs(uri)
    if "/" in path:
        system.create_dir(path.rpartition("/")[0] or "/", recursive=True)
    return system.open_output_stream(path, compression=None)


def open_random(uri: str):
    system, path = open_fs(uri)
    return system.open_input_file(path)


def visible_files(uri: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of a file, or of a folder's files, sorted, without hidden ones and folders. Paths are without the scheme."""
    system, path = open_fs(uri)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def write_whole(uri: str, data: bytes) -> None:
    """A reader sees the old file or the new one."""
    system, path = open_fs(uri)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(attempt, compression=None) as out:
        out.write(data)
    system.move(attempt, path)
