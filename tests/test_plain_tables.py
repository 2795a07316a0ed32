import random

import numpy as np
import pyarrow as pa

from turfspark.sources import pages
from turfspark.sources.plain_tables import plain_rows, tag_kind

PLAIN = "<html><p>x</p><table class='a'><thead><tr><th>a</th></tr></thead>\n<tbody><tr></tr><tr><td>1 <br/> 2</td> <td> é　ü </td></tr></tbody></table> t <TABLE><tr><TD title=\"b\">c<a href='/x' b=c>d</a></TD></tr></TABLE>"
ODD = [
    "<table><tr><td rowspan=2>a</td></tr><tr><td>b</td></tr></table>", "<table><tr><td>a<td>b<tr><td>c</table>", "<table><tr><td>a &amp; b</td></tr></table>",
    "<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>", "<!-- <table><tr><td>a</td></tr></table> -->", "<script>'<table><tr><td>a</td></tr></table>'</script>",
    '<table><tr><td title="<b>">a</td></tr></table>', '<table><tr><td title="a>b">a</td></tr></table>', "<table><tr><td>a < b</td></tr></table>", "<table><tr><td/><td>a</td></tr></table>",
    "<table><tr><td>a<BR>b</td></tr></table>", "<td>a</td>", "<table><tr><td>a</td></tr>", "<table><tr><td title='a>b</td></tr></table>",
]


def both(texts):
    """Rows by page, and the pages that aren't plain; the former equal the parser's."""
    column = pa.array(["cut off", *texts]).slice(1)
    other, page, table, row, cells = plain_rows(column)
    got = {i: [] for i in range(len(texts)) if i not in set(other.tolist())}
    for i, *x in zip(page.tolist(), table.tolist(), row.tolist(), cells.to_pylist(), strict=True):
        got[i].append(tuple(x))
    for i, rows in got.items():
        assert rows == pages.table_rows(texts[i]), texts[i]
    return got, other.tolist()


def test_plain_pages_are_read_as_the_parser_reads_them():
    got, other = both([PLAIN, None, "", *ODD, "a > b", PLAIN * 3])
    assert got[0] == [(0, 0, ["a"]), (0, 2, ["1 br 2", "é ü"]), (1, 0, ["cd"])] and got[1] == got[2] == []
    assert other == list(range(3, 3 + len(ODD) + 1)) and len(got[4 + len(ODD)]) == 9


def test_random_pages_equal_the_parser():
    rnd = random.Random(7)
    parts = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th x=1>", "</th>", "<br>", "<br/>", "<b>", "</b>", "<tbody>", "</tbody>", "a", " ", "b c", "　", "\xa0", " é", "\x1c", "\n", "→", "”"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(9))) for _ in range(4000)]

    def cell():
        text = "".join(rnd.choice(parts[8:12] + parts[14:]) for _ in range(rnd.randrange(5)))
        return f"<td>{text}</td>" + rnd.choice(["", " ", "x<b>"])

    def table():
        return "<table>" + "".join(rnd.choice(["<tr>", "<tr > <i>", "</tbody><tr id='q'>"]) + "".join(cell() for _ in range(rnd.randrange(4))) + "</tr>" for _ in range(rnd.randrange(4))) + "</table>"

    whole = [rnd.choice(["", "<p>", "é "]) + "".join(table() for _ in range(rnd.randrange(3))) for _ in range(2000)]
    mixed = [t for pair in zip(whole, texts[:2000], strict=True) for t in pair] + texts[2000:]
    got, _ = both(mixed)
    assert set(range(0, 4000, 2)) <= set(got)


def test_all_pages_are_read(spark, monkeypatch):
    texts = [*ODD, PLAIN, None, *ODD, PLAIN] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "page_id int, html string").coalesce(1)
    want = sorted((i, *r) for i, t in enumerate(texts) for r in pages.table_rows(t))
    assert sorted(map(tuple, pages.pages_to_tables(df).collect())) == want
    monkeypatch.setattr(pages, "MAX_CHARS", 100)
    assert [x for s in pages._slices(pa.array(texts)) for x in range(*s)] == list(range(len(texts)))


def test_plain_pages_are_not_parsed_one_by_one():
    other, *_ = plain_rows(pa.array([PLAIN] * 100))
    assert isinstance(other, np.ndarray) and len(other) == 0 and tag_kind(b"td ROWSPAN=1") == tag_kind(b"!--x--")
