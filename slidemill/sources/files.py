"""Opening files of any store that Arrow knows, at executors."""

from __future__ import annotations


def store_of(uri: str) -> tuple:
    """The store of a URI or path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def opened(uri: str):
    """A seekable file for reading: a URI of a store, or a path."""
    store, path = store_of(uri)
    return store.open_input_file(path)
