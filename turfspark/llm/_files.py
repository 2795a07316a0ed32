"""Binary files in the shared folder, from inside tasks. URIs of any store that Arrow knows."""

from collections.abc import Callable
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """Output stream of a new file; its folder is made."""
    store, path = resolve(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def opened(uri: str, offset: int = 0) -> Callable[[int], bytes]:
    """Reader of up to n bytes from ``offset`` on."""
    store, path = resolve(uri)
    source = store.open_input_file(path)
    source.seek(offset)
    return source.read


def spans(uri: str, dtype: str) -> Callable[[int, int], np.ndarray]:
    """Reader of elements a to b of a flat file: memory-mapped where the store is a mounted file system, else by
    ranged reads."""
    store, path = resolve(uri)
    if isinstance(store, fs.LocalFileSystem):
        whole = np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.zeros(0, dtype)
        return lambda a, b: np.array(whole[a:b])
    source, size = store.open_input_file(path), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(source.read_at((b - a) * size, a * size), dtype)


def exact(array: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.ascontiguousarray(array))
