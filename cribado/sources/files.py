"""File systems by path, the same on the driver and in tasks."""

from __future__ import annotations

from importlib import import_module

import pyarrow.fs as pafs

#: Schemes that Hadoop and Arrow call by different names.
ALIASES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def resolve(path: str, factory: str = "") -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it.

    `factory` names a function (`module:function`) that makes the file system, for those Arrow does not know by their
    scheme; it gets the path and returns both.
    """
    if factory:
        module, _, function = factory.partition(":")
        return getattr(import_module(module), function)(path)
    scheme, separator, rest = path.partition("://")
    if separator:
        return pafs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}://{rest}")
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), path[len("file:") :]
    return pafs.LocalFileSystem(), path


def is_local(filesystem: pafs.FileSystem) -> bool:
    return isinstance(filesystem, pafs.LocalFileSystem)


def replace(filesystem: pafs.FileSystem, source: str, target: str) -> None:
    """Move a finished file to its name; a file that a repeated task left there gives way."""
    if filesystem.get_file_info(target).type != pafs.FileType.NotFound:
        filesystem.delete_file(target)
    filesystem.move(source, target)
