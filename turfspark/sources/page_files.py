"""A source of saved pages: ``spark.read.format("pages")`` and ``spark.readStream.format("pages")``.

A row per file of a folder and the folders below it: ``page_id`` (the file's name before its ending), ``html``,
``charset`` (the one it was read in) and ``damaged`` (some bytes didn't belong to that charset and are replacement
characters in ``html``). Empty files are empty pages. Many files go into one partition, by bytes, so a folder of small
files doesn't make a task for each; a task reads one file at a time.

The charset is that of a byte order mark, or else the one that the page declares in its head, or else the first of
``TRIED`` in which all bytes are valid, or else UTF-8. Option ``charset`` sets it for all pages instead.

Options: ``path``, ``glob`` (``*.bin``), ``partBytes`` (64 MB), ``charset``, and for streams ``settleSeconds`` (1): a
file is taken once it is that old. A stream's offset is the last file's time and name, in whose order files are taken;
so a file counts once, and a trigger that runs again reads the same files. A file that appears later with an older
time than the offset is not seen.
"""

import codecs
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .scratch import store_of

SCHEMA = "page_id string, html string, charset string, damaged boolean"
#: Byte order marks with their charsets; charsets tried in this order; declared names that stand for a wider charset.
MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
TRIED = ["utf-8", "euc_jp", "cp932"]
WIDER = {"shift_jis": "cp932", "iso8859-1": "cp1252", "ascii": "cp1252"}
HEAD_BYTES, PART_BYTES, FILE_BYTES, BATCH_BYTES = 4096, 64 << 20, 64 << 10, 4 << 20
_DECLARED = re.compile(rb"""<meta\s[^>]*?charset\s*=\s*["']?\s*([\w.:-]+)""", re.IGNORECASE)


def known_charset(name: str) -> str | None:
    """Python's name of a charset, or nothing."""
    try:
        found = codecs.lookup(name.strip().replace("x-sjis", "shift_jis")).name
        return WIDER.get(found, found) if isinstance(b"".decode(found), str) else None
    except (LookupError, ValueError):
        return None


def decoded(content: bytes, charset: str | None = None) -> tuple[str, str, bool]:
    """(text, charset, damaged) of a page's bytes."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return _in(content[len(mark) :], name)
    declared = _DECLARED.search(content[:HEAD_BYTES])
    for name in (charset, declared and declared[1].decode("ascii", "replace")):
        found = known_charset(name) if name else None
        if found and not (found.startswith("utf-16") and name != charset):  # a page whose head can be read as ASCII isn't UTF-16
            return _in(content, found)
    for name in TRIED:
        try:
            return content.decode(name), name, False
        except UnicodeDecodeError:
            pass
    return _in(content, "utf-8")


def _in(content: bytes, charset: str) -> tuple[str, str, bool]:
    try:
        return content.decode(charset), charset, False
    except UnicodeDecodeError:
        return content.decode(charset, "replace"), charset, True


def page_key(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[0] or name


@dataclass
class Files(InputPartition):
    """Paths of one partition."""

    paths: list[str]


def packed(files: list[tuple[str, int]], part_bytes: int) -> list[Files]:
    """Files (path, size) dealt to partitions of ``part_bytes`` or one file; each file counts ``FILE_BYTES`` at least, as
    opening it costs as much as reading some."""
    out, size = [], 0
    for path, n in files:
        n = max(n, FILE_BYTES)
        if not out or size + n > part_bytes:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(path)
        size += n
    return out


class _Folder:
    """What batch and stream have in common."""

    def __init__(self, options: dict):
        self.folder, self.glob = options["path"], options.get("glob", "*.bin")
        self.part_bytes, self.charset = int(options.get("partbytes", PART_BYTES)), options.get("charset")
        if self.charset and not known_charset(self.charset):
            raise ValueError(f"unknown charset {self.charset}")

    def files(self) -> list[fs.FileInfo]:
        store, base = store_of(self.folder)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=False))
        return [f for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob) and not f.base_name.startswith((".", "_"))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.folder)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as f:
                content = f.read()
            rows.append((page_key(path), *decoded(content, self.charset)))
            size += len(content)
            if size >= BATCH_BYTES or len(rows) >= 10_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "html", "charset", "damaged"])


class _Batch(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return packed([(f.path, f.size) for f in sorted(self.files(), key=lambda f: f.path)], self.part_bytes) or [Files([])]


class _Stream(_Folder, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.settle = float(options.get("settleseconds", 1))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _after(self, offset: dict) -> list[tuple[int, str, int]]:
        found = sorted((f.mtime_ns, f.path, f.size) for f in self.files())
        return [x for x in found if x[:2] > (offset["time"], offset["path"])]

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        ready = [x for x in self._after(self.initialOffset()) if x[0] <= until]
        return {"time": ready[-1][0], "path": ready[-1][1]} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return packed([(p, n) for t, p, n in self._after(start) if (t, p) <= (end["time"], end["path"])], self.part_bytes)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)
