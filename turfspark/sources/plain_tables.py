"""Rows of the tables of many pages at once, array-wise, where the markup is plain; other pages are named, for a parser to read.

A page is plain if every ``<`` begins a tag and every ``>`` ends one, its tags are well formed, and each table, row and cell is closed before the next one
begins, without cells over several rows or columns, tables within tables, references (``&``), comments, or elements whose content
isn't markup. Text and tags of other kinds may stand anywhere. For such pages what follows what is a matter of two
tags side by side, so a batch of pages is checked by a table of such pairs."""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OTHER, _BREAK, _BAD, _NONE, _TABLE, _TABLE_END, _ROW, _ROW_END, _CELL, _CELL_END, _SECTION = range(11)
_KINDS = {b"table": _TABLE, b"/table": _TABLE_END, b"tr": _ROW, b"/tr": _ROW_END, b"td": _CELL, b"/td": _CELL_END, b"th": _CELL, b"/th": _CELL_END}
_KINDS |= {end + name: _SECTION for name in (b"thead", b"tbody", b"tfoot") for end in (b"", b"/")}
_NEXT = {
    _NONE: [_TABLE], _TABLE: [_ROW, _SECTION, _TABLE_END], _SECTION: [_ROW, _SECTION, _TABLE_END], _ROW: [_CELL, _ROW_END], _CELL: [_CELL_END],
    _CELL_END: [_CELL, _ROW_END], _ROW_END: [_ROW, _SECTION, _TABLE_END], _TABLE_END: [_TABLE],
}
_FOLLOWS = np.zeros((11, 11), bool)
for _kind, _after in _NEXT.items():
    _FOLLOWS[_kind, _after] = True
#: Elements whose content html.parser, or a browser, doesn't take as markup.
_RAW = {b"script", b"style", b"title", b"textarea", b"xmp", b"iframe", b"noembed", b"noframes", b"noscript", b"plaintext", b"svg", b"math"}
_END = re.compile(rb"/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*")
_START = re.compile(rb"""([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z_][\w.:-]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'=`/]+))?)*)[ \t\n\r\f]*(/?)""")
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True


@lru_cache(4096)
def tag_kind(body: bytes) -> int:
    """What stands between ``<`` and ``>``."""
    end = _END.fullmatch(body)
    if end:
        name = end[1].lower()
        return _BAD if name in _RAW else _KINDS.get(b"/" + name, _OTHER)
    start = _START.fullmatch(body)
    if not start or start[1].lower() in _RAW:
        return _BAD
    if start[1] == b"br":
        return _BREAK
    kind = _KINDS.get(start[1].lower(), _OTHER)
    return _BAD if start[1].lower() == b"br" or kind != _OTHER and (start[3] or b"span" in start[2].lower()) else kind


def _packed(bodies: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to eight bytes as a number; 0 of longer ones."""
    bits = 8 * (8 - np.minimum(sizes, 8)).astype(np.uint64)
    return np.where((sizes > 0) & (sizes <= 8), bodies.view(">u8").ravel().astype(np.uint64) >> np.minimum(bits, np.uint64(63)), np.uint64(0))


_SHORT = {int.from_bytes(x): k for x, k in (_KINDS | {b"br": _BREAK, b"br/": _BREAK, b"br /": _BREAK}).items()}
_CODES = np.array(sorted(_SHORT), np.uint64)
_CODE_KINDS = np.array([_SHORT[int(x)] for x in _CODES], np.int8)


def _kinds(data: np.ndarray, lt: np.ndarray, gt: np.ndarray) -> np.ndarray:
    window = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(9, np.uint8)], 8)
    sizes = gt - lt - 1
    code = _packed(np.ascontiguousarray(window[lt + 1]), sizes)
    at = np.minimum(np.searchsorted(_CODES, code), len(_CODES) - 1)
    kinds = np.where(_CODES[at] == code, _CODE_KINDS[at], -1).astype(np.int8)
    for i in np.flatnonzero(kinds < 0):
        kinds[i] = tag_kind(data[lt[i] + 1 : gt[i]].tobytes())
    return kinds


def _spaces(out: np.ndarray) -> np.ndarray:
    """Where text has to be looked at: blanks other than single spaces."""
    blank = _SPACE[out]
    odd = blank & (out != 32)
    odd[1:] |= blank[1:] & blank[:-1]
    at = np.flatnonzero((out == 0xC2) | (out >= 0xE1) & (out <= 0xE3))
    if len(at):
        a, (b, c) = out[at], (np.r_[out, np.zeros(2, np.uint8)][at + k] for k in (1, 2))
        odd[at] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.flatnonzero(odd)


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray, lt: np.ndarray, gt: np.ndarray, kinds: np.ndarray) -> pa.Array:
    """The cells' texts: without tags, a break as ``br``, runs of blanks as one space."""
    step = np.zeros(len(data) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    inside = np.cumsum(step, dtype=np.int8)[:-1].view(bool)
    inner = inside[lt]
    if inner.any():
        step[:] = 0
        step[lt[inner]] += 1
        step[gt[inner] + 1] -= 1
        inside &= ~np.cumsum(step, dtype=np.int8)[:-1].view(bool)
        breaks = lt[inner & (kinds == _BREAK)]
        inside[breaks + 1] = inside[breaks + 2] = True
    before = np.r_[np.int32(0), np.cumsum(inside, dtype=np.int32)]
    offsets = np.r_[np.int32(0), np.cumsum(before[end] - before[start], dtype=np.int32)]
    out = data[inside]
    cells = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(out))
    look = np.zeros(len(start), bool)
    look[np.searchsorted(offsets, _spaces(out), "right") - 1] = True
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    look[full] |= _SPACE[out[offsets[full]]] | _SPACE[out[offsets[full + 1] - 1]]
    if look.any():
        look = pa.array(look)
        cells = pc.replace_with_mask(cells, look, pa.array([" ".join(x.split()) for x in cells.filter(look).to_pylist()], pa.string()))
    return cells


def plain_rows(html: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(numbers of pages that aren't plain; page, table and row number of each row of the others, and its cells)."""
    html = pc.fill_null(html.cast(pa.string()), "")
    bounds = np.frombuffer(html.buffers()[1], np.int32)[html.offset : html.offset + len(html) + 1]
    data = np.frombuffer(html.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    page_of = lambda at: np.searchsorted(bounds, at, "right") - 1
    bad = np.zeros(len(html), bool)
    bad[page_of(np.flatnonzero((data == 38) | (data == 0)))] = True
    # in plain pages < and > take turns
    at = np.flatnonzero((data == 60) | (data == 62))
    page = page_of(at)
    first = np.searchsorted(page, np.arange(len(html) + 1))
    bad |= np.diff(first) % 2 == 1
    bad[page[((np.arange(len(at)) - first[page]) % 2 == 0) != (data[at] == 60)]] = True
    at = at[~bad[page]]
    lt, gt = at[::2], at[1::2]
    kinds, page = _kinds(data, lt, gt), page_of(lt)
    bad[page[kinds == _BAD]] = True
    some = kinds > _NONE
    p, k = page[some], kinds[some]
    new = np.r_[True, p[1:] != p[:-1]][: len(p)]
    bad[p[~_FOLLOWS[np.where(new, _NONE, np.r_[_NONE, k[:-1]][: len(k)]), k]]] = True
    last = np.r_[new[1:], True][: len(p)]
    bad[p[last & (k != _TABLE_END)]] = True
    good = ~bad[page]
    lt, gt, kinds, page = lt[good], gt[good], kinds[good], page[good]
    tables, rows = np.cumsum(kinds == _TABLE), np.cumsum(kinds == _ROW)  # up to each tag
    is_table, is_row, is_cell = kinds == _TABLE, kinds == _ROW, kinds == _CELL
    cells = np.bincount(rows[is_cell], minlength=is_row.sum() + 1)[1:]
    row_page, row_table = page[is_row], tables[is_row]
    table_no = row_table - 1 - np.searchsorted(page[is_table], row_page)
    row_no = np.arange(len(cells)) - rows[is_table][row_table - 1]
    texts = _texts(data, gt[is_cell] + 1, lt[kinds == _CELL_END], lt[kinds < _NONE], gt[kinds < _NONE], kinds[kinds < _NONE])
    full = cells > 0
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cells[full])].astype(np.int32)), texts)
    return np.flatnonzero(bad), row_page[full], table_no[full], row_no[full], lists
