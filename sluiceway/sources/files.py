"""Folders by path or URI, on any file system that pyarrow knows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def filesystem(folder: str):
    """The file system and the path in it of a folder: a path of this machine, or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def files_in(folder: str, ending: str, recursive: bool = False) -> list:
    """What pyarrow knows of the folder's files of that ending, in order of their names; none where the folder isn't there."""
    from pyarrow import fs

    files, root = filesystem(folder)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=recursive))
    return sorted((i for i in found if i.type == fs.FileType.File and i.base_name.endswith(ending)), key=lambda i: i.path)


def write_whole(folder: str, name: str, data: bytes) -> None:
    """Writes a file under its final name once it is whole."""
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/{name}.part") as out:
        out.write(data)
    files.move(f"{root}/{name}.part", f"{root}/{name}")


def size_of(folder: str, name: str) -> int | None:
    """The size of a file, None where it isn't there."""
    from pyarrow import fs

    files, root = filesystem(folder)
    info = files.get_file_info(f"{root}/{name}")
    return info.size if info.type == fs.FileType.File else None


def remove(folder: str, name: str) -> bool:
    """Deletes a file; whether it was there."""
    files, root = filesystem(folder)
    try:
        files.delete_file(f"{root}/{name}")
        return True
    except FileNotFoundError:
        return False


def json_lines(folder: str, ending: str) -> Iterator[dict]:
    """The rows of the folder's files of JSON lines, those of its subfolders too."""
    files, _ = filesystem(folder)
    for info in files_in(folder, ending, recursive=True):
        with files.open_input_stream(info.path) as f:
            for line in f.read().splitlines():
                if line.strip():
                    yield json.loads(line)


def write_tree(rows: DataFrame, root: str) -> int:
    """Writes each row's text as a file at its path below the root, from the tasks; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folder, _, name = f"{root}/{path}".rpartition("/")
                write_whole(folder, name, (text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return sum(r.n for r in rows.select("path", "text").mapInArrow(run, "n bigint").collect())
