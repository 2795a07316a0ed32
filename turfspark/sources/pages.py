"""Tables and links out of HTML pages."""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plain_tables import plain_rows

LINKS = {
    "horse": r"/horse/(\d+)", "jockey": r"/jockey/result/recent/(\w+)", "trainer": r"/trainer/result/recent/(\w+)", "owner": r"/owner/result/recent/(\w+)",
    "ancestor": r"/horse/(?:ped/)?(\w{10})",
}


def extract_links(pages: DataFrame, pattern: str, key: str = "page_id", html: str = "html", name: str = "link") -> DataFrame:
    """(key, pos, link): every match of the pattern's group, in order."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), 1)).alias("pos", name))


#: The largest spans that count, as browsers have it.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65_534
MAX_CHARS = 1 << 22
_SECTIONS = ("thead", "tbody", "tfoot")


def _span(attrs: dict, name: str, most: int) -> int:
    """A span as given; what isn't a number is 1, and 0 (for rows: up to the section's end) stays."""
    found = re.match(r"\s*(\d+)", attrs.get(name) or "")
    return min(int(found[1]), most) if found else 1


class _Grid:
    """The rows of one table as a grid: for each column the text that still covers it and for how many rows."""

    def __init__(self, no: int):
        self.no, self.row, self.cells, self.open, self.covered = no, -1, None, None, {}

    def begin_row(self):
        self.row, self.cells = self.row + 1, {}
        for column, (text, left) in list(self.covered.items()):
            self.cells[column] = text
            if left > 1:
                self.covered[column] = (text, left - 1)
            else:
                del self.covered[column]
        self.at = 0

    def place(self, text: str, down: int, right: int):
        """A cell goes to the first column that isn't taken, and over the next ones, taken or not."""
        while self.at in self.cells:
            self.at += 1
        for column in range(self.at, self.at + max(right, 1)):
            self.cells[column] = text
            if down != 1:
                self.covered[column] = (text, down - 1 if down else MAX_ROWSPAN)
        self.at += max(right, 1)

    def line(self) -> list[str]:
        return [self.cells.get(i, "") for i in range(max(self.cells) + 1)]


class _Tables(HTMLParser):
    """Cells of all tables; a nested table's cells are its own; ``<br>`` in a cell is kept as ``br``. A cell that spans rows or
    columns is repeated in each of them, but not beyond its section (head, body or foot)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.tables = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append(_Grid(self.tables))
            self.tables += 1
        elif self.open:
            t = self.open[-1]
            if tag == "tr":
                self._end_row(t)
                t.begin_row()
            elif tag in ("td", "th"):
                self._end_cell(t)
                if t.cells is None:
                    t.begin_row()
                given = dict(attrs)
                t.open = ([], _span(given, "rowspan", MAX_ROWSPAN), _span(given, "colspan", MAX_COLSPAN))
            elif tag in _SECTIONS:
                self._end_section(t)
            elif tag == "br" and t.open is not None:
                t.open[0].append("br")

    def handle_data(self, data):
        if self.open and self.open[-1].open is not None:
            self.open[-1].open[0].append(data)

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th"):
            self._end_cell(t)
        elif tag == "tr":
            self._end_row(t)
        elif tag in _SECTIONS:
            self._end_section(t)
        elif tag == "table":
            self._end_row(t)
            self.open.pop()

    def _end_cell(self, t):
        if t.open is not None:
            text, down, right = t.open
            t.place(" ".join("".join(text).split()), down, right)
            t.open = None

    def _end_row(self, t):
        self._end_cell(t)
        if t.cells:
            self.rows.append((t.no, t.row, t.line()))
        t.cells = None

    def _end_section(self, t):
        self._end_row(t)
        t.covered.clear()

    def finish(self):
        self.close()
        while self.open:
            self._end_row(self.open.pop())
        return self.rows


def table_rows(html: str | None) -> list[tuple[int, int, list[str]]]:
    parser = _Tables()
    parser.feed(html or "")
    return sorted(parser.finish(), key=lambda r: r[:2])


def pages_to_tables(pages: DataFrame, key: str = "page_id", html: str = "html", parse=table_rows, rows: int = 1000) -> DataFrame:
    """(key, table_no, row_no, cells) of every table row; ``parse`` may be any function of one page's text
    that yields (table, row, cells). Pages of plain markup are read array-wise, about ``MAX_CHARS`` bytes of them at a time
    (``plain_tables``); others, and all where ``parse`` is given, are parsed one at a time, and rows of several pages leave the
    task together, ``rows`` or about ``MAX_CHARS`` characters at a time."""
    schema = T.StructType([
        T.StructField(key, pages.schema[key].dataType), T.StructField("table_no", T.IntegerType()), T.StructField("row_no", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = range(b.num_rows)
            if parse is table_rows:
                left = []
                for begin, end in _slices(b.column(1)):
                    other, *found = plain_rows(b.column(1).slice(begin, end - begin))
                    left += (other + begin).tolist()
                    if len(found[0]):
                        yield batch(b, found[0] + begin, *found[1:])
            page, found, size = [], [], 0
            for i in left:
                for row in parse(b.column(1)[i].as_py()):
                    page.append(i)
                    found.append(row)
                    size += sum(map(len, filter(None, row[2])))
                    if len(found) == rows or size > MAX_CHARS:
                        yield batch(b, page, *zip(*found, strict=True))
                        page, found, size = [], [], 0
            if found:
                yield batch(b, page, *zip(*found, strict=True))

    def batch(b: pa.RecordBatch, page, table, row, cells) -> pa.RecordBatch:
        cells = pa.array(cells, pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(page, pa.int32())), pa.array(table, pa.int32()), pa.array(row, pa.int32()), cells], schema.names)

    return pages.select(key, html).mapInArrow(run, schema)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that have ``MAX_CHARS`` bytes together, or one text more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MAX_CHARS)) + 1
        yield at, min(upto, len(ends))
        at = upto


def main_table(rows: DataFrame, columns: list[str], key: str = "page_id", table_no: int = 0, header: bool = True) -> DataFrame:
    """One table's rows as named columns."""
    kept = rows.filter((F.col("table_no") == table_no) & (F.col("row_no") >= int(header)))
    return kept.select(key, *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def create_return_rows(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Payout rows (kind, win, payout) of all tables with three cells, in the shape that ``parse_payouts`` takes."""
    return rows.filter(F.size("cells") >= 3).select(F.col(key).cast("string").alias("race_id"), F.col("cells")[0].alias("kind"), F.col("cells")[1].alias("win"), F.col("cells")[2].alias("payout"))
