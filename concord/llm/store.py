"""Folders of files that tasks write themselves: unique names, and a manifest that the driver commits.

A task's file counts only if the manifest names it, so a task that is lost or run
twice leaves at most a file that no reader opens.
"""

from __future__ import annotations

import json
import uuid

from concord.llm.shared import filesystem

MANIFEST = "_manifest.json"


def new_file(folder: str, suffix: str) -> str:
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """A stream for writing a new file; its folder is made."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_file(uri: str):
    """A file for reading at any place."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def commit(folder: str, files: list[dict]) -> None:
    """Adds files to the folder's manifest."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    known = _manifest(fs, path) or []
    with create(f"{folder.rstrip('/')}/{MANIFEST}") as f:
        f.write(json.dumps(known + files).encode())


def _manifest(fs, path: str) -> list[dict] | None:
    try:
        with fs.open_input_file(f"{path}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def committed(folder: str) -> list[dict]:
    """What the manifest names; without one, all files of the folder, in order."""
    from pyarrow import fs as pafs

    fs, path = filesystem(folder)
    known = _manifest(fs, path)
    if known is not None:
        return known
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    scheme = folder.partition("://")[0] + "://" if "://" in folder else ""
    host = folder[len(scheme) :].partition("/")[0] if scheme and scheme != "file://" else ""
    names = sorted(x.path for x in found if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))
    return [{"file": f"{scheme}{host}{'/' if host and not x.startswith('/') else ''}{x}"} for x in names]


def remove(files: list[str]) -> None:
    for uri in files:
        fs, path = filesystem(uri)
        try:
            fs.delete_file(path)
        except OSError:  # it was never finished
            continue
