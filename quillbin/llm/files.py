"""Binary files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_part(folder: str, part: int, suffix: str):
    """An output stream and its address.

    The name is unique to the attempt: a task that is run again writes another file, and
    only the one named in the row that the task returned is ever read.
    """
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"part-{part:06d}-{uuid.uuid4().hex}{suffix}"
    return system.open_output_stream(f"{path}/{name}"), f"{folder}/{name}"


def write_at(address: str):
    """An output stream to an address that no other attempt of a task has."""
    system, path = fs.FileSystem.from_uri(address)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def open_part(address: str):
    system, path = fs.FileSystem.from_uri(address)
    return system.open_input_stream(path)


def open_places(address: str):
    """A file to read at any place."""
    system, path = fs.FileSystem.from_uri(address)
    return system.open_input_file(path)


def remove(folder: str) -> None:
    """Removes a folder of such files, if there is one."""
    system, path = fs.FileSystem.from_uri(folder)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
