"""The rows of a worksheet's XML in Arrow arrays, many at a time.

The usual form of a row (``<row r>`` with ``<c r t>`` cells of one inline text, value
or formula and value) is found by NumPy in the bytes: every tag must be one that is
known, follow one it may follow and have attributes that read well, so what passes is
well formed. Rows of any other form (rich text, prefixes, carriage returns) go through
the XML parser with the sheet's own beginning, and a sheet with comments, CDATA or
processing instructions goes through it whole; it also gives the errors.
"""

from __future__ import annotations

import html
import re
from xml.etree import ElementTree as ET

import numpy as np

CHUNK_BYTES, LONGEST_ROW = 1 << 19, 16 << 20
_END = b"</row>"

# --- tags --------------------------------------------------------------------

(_OTHER, _ROW, _ROW_END, _ROW_EMPTY, _C, _C_END, _C_EMPTY, _IS, _IS_END, _T, _T_END, _V, _V_END, _F, _F_END) = range(15)
_TAGS = {b"</row>": _ROW_END, b"</c>": _C_END, b"<is>": _IS, b"</is>": _IS_END, b"<t>": _T, b"</t>": _T_END, b"<v>": _V, b"</v>": _V_END,
         b"<f>": _F, b"</f>": _F_END, b"<t xml:s": _T, b'<row r="': _ROW, b'<c r="': _C}
_T_SPACE = b'<t xml:space="preserve">'
_FOLLOWS = {_ROW: (_C, _C_EMPTY, _ROW_END), _C: (_IS, _V, _F, _C_END), _IS: (_T,), _T: (_T_END,), _T_END: (_IS_END,), _IS_END: (_C_END,),
            _V: (_V_END,), _V_END: (_C_END,), _F: (_F_END,), _F_END: (_V, _C_END), _C_END: (_C, _C_EMPTY, _ROW_END),
            _C_EMPTY: (_C, _C_EMPTY, _ROW_END), _ROW_END: (_ROW, _ROW_EMPTY), _ROW_EMPTY: (_ROW, _ROW_EMPTY)}


def _word(b: bytes) -> int:
    return int.from_bytes(b.ljust(8, b"\0")[:8], "little")


def _hashed(keys):
    """(multiplier, table of keys, table of kinds): a table of 64 without collisions."""
    words = np.array([_word(k) for k in keys], np.uint64)
    for seed in range(1, 10_000):
        m = np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
        at = (words * m) >> np.uint64(58)
        if len(set(at.tolist())) == len(words):
            table, kinds = np.zeros(64, np.uint64), np.zeros(64, np.uint8)
            table[at], kinds[at] = words, list(keys.values())
            return m, table, kinds
    raise AssertionError("no table")


_MUL, _KEYS, _KINDS = _hashed(_TAGS)
_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)
_MAY = np.zeros(256, bool)
for _a, _bs in _FOLLOWS.items():
    for _b in _bs:
        _MAY[_a * 16 + _b] = True
_TEXT_AT = np.zeros(16, np.int64)  # where a cell's text is, by the tag after its own
_TEXT_AT[_IS], _TEXT_AT[_V], _TEXT_AT[_F] = 2, 1, 3
_ATTRIBUTES = re.compile(rb'"((?: [a-zA-Z0-9:]+="[^"<&]*")*) ?/?>')
_ENTITY = re.compile(r"&(?:lt|gt|amp|quot|apos);")


def _attributes(rest: bytes, root: bytes, own: bytes) -> dict | None:
    """Of the rest of a start tag, from the quote that ends ``own``; None if it has to
    be left to the parser."""
    m = _ATTRIBUTES.fullmatch(rest)
    if m is None or not rest.isascii():
        return None
    found = re.findall(rb' ([^ =]+)="([^"]*)"', m.group(1))
    names = [k for k, _ in found]
    if len({own, *names}) <= len(names) or any(not re.fullmatch(rb"[a-zA-Z][a-zA-Z0-9]*(:[a-zA-Z][a-zA-Z0-9]*)?", k) for k in names):
        return None
    prefixes = [k.split(b":")[0] for k in names if b":" in k]
    if len(prefixes) > 1 or any(k.startswith(b"xmlns") for k in names) or any(b" xmlns:" + x + b"=" not in root for x in prefixes):
        return None
    return dict(found)


def _spans(buf, starts, ends, kind):
    """The slices of a buffer as an Arrow array of twice their number: every second one."""
    import pyarrow as pa
    at = np.empty(2 * len(starts), np.int32)
    at[0::2], at[1::2] = starts, ends
    return pa.Array.from_buffers(kind, max(len(at) - 1, 0), [None, pa.py_buffer(at), buf])


def _rests(buf, starts, ends, root, own):
    """(code of each start tag's rest, the attributes by code) or None."""
    import pyarrow as pa
    codes = _spans(buf, starts, ends, pa.binary()).take(pa.array(np.arange(0, 2 * len(starts), 2, dtype=np.int32))).dictionary_encode()
    if len(codes.dictionary) > 10_000:
        return None
    known = [_attributes(r, root, own) for r in codes.dictionary.to_pylist()]
    return None if any(k is None for k in known) else (codes.indices.to_numpy(), known)


def _plain_rows(chunk: bytes, root: bytes, shared: list[str]):
    """(all row numbers, which rows have values, their cells) of a run of rows, or None if
    they aren't all of the usual form. ``root``: the start tag that declares prefixes."""
    import pyarrow as pa
    padded = chunk + bytes(24)
    a = np.frombuffer(chunk, np.uint8)
    low = a < 32
    if low.any() and not np.isin(a[low], (9, 10)).all():
        return None
    if not chunk.isascii():
        try:
            chunk.decode()
        except UnicodeDecodeError:
            return None
        if (a == 0xEF).any() and (b"\xef\xbf\xbe" in chunk or b"\xef\xbf\xbf" in chunk):
            return None
    lt, gt = np.flatnonzero(a == 60), np.flatnonzero(a == 62)
    if len(lt) != len(gt) or not (lt < gt).all() or not (gt[:-1] < lt[1:]).all():
        return None

    # what each tag is
    words = np.ndarray((len(chunk) + 17,), "<u8", padded, strides=(1,))
    w = words[lt]
    size = np.minimum(gt - lt + 1, 8)
    key = w & _MASK[np.where((w >> np.uint64(8)) & np.uint64(255) == 99, 6, size)]  # of a cell's tag the part before its name
    slot = ((key * _MUL) >> np.uint64(58)).astype(np.intp)
    kind = _KINDS[slot] * (_KEYS[slot] == key)
    long_t = np.flatnonzero(w == _word(_T_SPACE))
    if len(long_t) and not ((gt[long_t] - lt[long_t] == 23).all() and (words[lt[long_t] + 8] == _word(_T_SPACE[8:])).all()
                            and (words[lt[long_t] + 16] == _word(_T_SPACE[16:])).all()):
        return None
    closed = a[gt - 1] == 47
    kind[closed & ((kind == _C) | (kind == _ROW))] += 2
    if kind[0] not in (_ROW, _ROW_EMPTY) or kind[-1] not in (_ROW_END, _ROW_EMPTY) or not _MAY[kind[:-1] * np.uint8(16) + kind[1:]].all():
        return None

    # rows: number and other attributes
    buf = pa.py_buffer(padded)
    ri = np.flatnonzero((kind == _ROW) | (kind == _ROW_EMPTY))
    number_w = words[lt[ri] + 8]
    row_no, digits, on = np.zeros(len(ri), np.int64), np.zeros(len(ri), np.int64), np.ones(len(ri), bool)
    for k in range(8):
        d = ((number_w >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) - 48
        on &= (d >= 0) & (d <= 9)
        row_no = np.where(on, row_no * 10 + d, row_no)
        digits += on
    number_end = lt[ri] + 8 + digits
    if not ((digits > 0) & (a[number_end] == 34)).all():
        return None
    if _rests(buf, number_end, gt[ri] + 1, root, b"r") is None:
        return None

    # cells: column, other attributes
    is_c = (kind == _C) | (kind == _C_EMPTY)
    ci = np.flatnonzero(is_c)
    if not len(ci):
        return row_no, np.zeros(0, np.int64), _cells(np.zeros(1, np.int32), pa.array([], pa.string()))
    row_of = np.searchsorted(ri, ci) - 1
    ref = lt[ci] + 6
    ref_w = words[ref]
    letters = np.zeros(len(ci), np.int64)
    col, on = np.zeros(len(ci), np.int64), np.ones(len(ci), bool)
    for k in range(3):
        d = ((ref_w >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) - 64
        on = on & (d >= 1) & (d <= 26)
        col = np.where(on, col * 26 + d, col)
        letters += on
    mask = _MASK[digits][row_of]
    ref_end = ref + letters + digits[row_of]
    if not ((letters > 0) & (words[ref + letters] & mask == number_w[row_of] & mask) & (ref_end < gt[ci])).all() or not (a[ref_end] == 34).all():
        return None
    rests = _rests(buf, ref_end, gt[ci] + 1, root, b"r")
    if rests is None:
        return None
    codes, known = rests
    types = np.array([(b"inlineStr", b"s", b"b").index(t) if (t := k.get(b"t", b"n")) in (b"inlineStr", b"s", b"b") else 3 for k in known])[codes]

    # texts
    after = kind[np.minimum(ci + 1, len(kind) - 1)]
    ti = ci + np.where(kind[ci] == _C, _TEXT_AT[after], 0)
    ti = np.minimum(ti, len(kind) - 1)
    has = (kind[ti] == _T) & (types == 0) | (kind[ti] == _V) & (types != 0) & (gt[ti] + 1 < lt[np.minimum(ti + 1, len(lt) - 1)])
    at = np.flatnonzero(has)
    ti, types, col, row_of = ti[at], types[at], col[at] - 1, row_of[at]
    starts, ends = gt[ti] + 1, lt[ti + 1] if len(ti) else gt[ti]
    texts = _spans(buf, starts, ends, pa.string())
    which = np.arange(0, 2 * len(ti), 2, dtype=np.int32)
    n_amp = np.count_nonzero(a == 38)
    if n_amp or (types == 1).any() or (types == 2).any():
        texts, which = _read(texts.take(pa.array(which)), types, n_amp, shared), np.arange(len(ti), dtype=np.int32)
        if texts is None:
            return None

    # a row's cells by column, up to its last value
    if not len(at):
        return row_no, np.zeros(0, np.int64), _cells(np.zeros(1, np.int32), pa.array([], pa.string()))
    first = np.flatnonzero(np.r_[True, row_of[1:] != row_of[:-1]])
    width = np.maximum.reduceat(col, first) + 1
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(width, out=offsets[1:])
    if offsets[-1] > 1 << 26:  # a few values far to the right in many rows
        return None
    source = np.full(offsets[-1], -1, np.int32)
    source[np.repeat(offsets[:-1], np.diff(np.r_[first, len(at)])) + col] = which
    values = texts.take(pa.array(source, mask=source < 0))
    return row_no, row_of[first], _cells(offsets.astype(np.int32), values)


def _read(texts, types, n_amp: int, shared: list[str]):
    """Values of cells' texts: entities, shared strings and booleans; None where the
    parser has to look."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if n_amp:
        if n_amp != (pc.sum(pc.count_substring(texts, "&")).as_py() or 0):
            return None  # elsewhere: in a formula, say
        at = np.flatnonzero(pc.match_substring(texts, "&").to_numpy(zero_copy_only=False))
        marked = texts.take(pa.array(at)).to_pylist()
        if any(len(_ENTITY.findall(t)) != t.count("&") for t in marked):
            return None
        texts = pc.replace_with_mask(texts, _mask(at, len(texts)), pa.array([html.unescape(t) for t in marked], pa.string()))
    at = np.flatnonzero(types == 1)
    if len(at):
        numbers = texts.take(pa.array(at)).to_pylist()
        if any(not (t.isascii() and t.isdigit() and int(t) < len(shared)) for t in numbers):
            return None
        texts = pc.replace_with_mask(texts, _mask(at, len(texts)), pa.array([shared[int(t)] for t in numbers], pa.string()))
    at = np.flatnonzero(types == 2)
    if len(at):
        told = pa.array(["TRUE" if t == "1" else "FALSE" for t in texts.take(pa.array(at)).to_pylist()], pa.string())
        texts = pc.replace_with_mask(texts, _mask(at, len(texts)), told)
    return texts


def _mask(at, n):
    import pyarrow as pa
    mask = np.zeros(n, bool)
    mask[at] = True
    return pa.array(mask)


def _cells(offsets, values):
    import pyarrow as pa
    return pa.ListArray.from_arrays(pa.array(offsets), values)


# --- a sheet -------------------------------------------------------------------

_CLOSE = b"</sheetData></worksheet>"
_BEGIN = re.compile(rb"(?:\xef\xbb\xbf)?(?:<\?xml(?P<says>[^<>]*)\?>)?\s*(?P<root><worksheet[\s>][^<>]*>?)")
_A_ROW = re.compile(rb"<(?:[^\s<>/]+:)?row[\s/>]")


class _Unusual(Exception):
    """The sheet has to go through the parser from its beginning."""


def _tag(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n - 1


def _row_of(ref: str) -> int:
    return int("".join(ch for ch in ref if ch.isdigit()))


def _cell_value(c, shared: list[str]):
    t = c.get("t", "n")
    if t == "inlineStr":
        is_ = c.find("{*}is")
        return None if is_ is None else "".join(x.text or "" for x in is_.iterfind(".//{*}t"))
    v = c.find("{*}v")
    if v is None or v.text is None:
        return None
    if t == "s":
        return shared[int(v.text)]
    if t == "b":
        return "TRUE" if v.text == "1" else "FALSE"
    return v.text  # numbers, formula strings ('str') and error codes ('e') as text


def _parsed_rows(fh, shared, first_row, last_row, done):
    """(row number, cells) by the XML parser. Row and column numbers come from the cell
    references, not from counting, so empty cells and rows are simply absent. ``done``
    gets an entry where the last wanted row has been passed."""
    for _, el in ET.iterparse(fh, events=("end",)):
        if _tag(el.tag) != "row":
            continue
        cells = el.findall("{*}c")
        ref = next((c.get("r") for c in cells if c.get("r")), None)
        rn = int(el.get("r")) if el.get("r") else _row_of(ref) if ref else None
        if rn is not None and last_row is not None and rn > last_row:
            done.append(rn)
            return
        if rn is not None and rn >= first_row:
            vals = {}
            for c in cells:
                if c.get("r") is None:
                    continue
                v = _cell_value(c, shared)
                if v is not None:
                    vals[_col_index(c.get("r"))] = v
            if vals:
                yield rn, [vals.get(i) for i in range(max(vals) + 1)]
        el.clear()


def _arrays(rows):
    import pyarrow as pa
    return np.array([r for r, _ in rows], np.int64), pa.array([c for _, c in rows], pa.list_(pa.string()))


def _by_chunks(fh, shared, first_row, last_row):
    """Batches of the rows of a sheet read a piece at a time; raises _Unusual where that
    can't be told to give what the parser gives."""
    import io

    import pyarrow as pa
    data = fh.read(CHUNK_BYTES)
    at = data.find(b"<row")
    prolog, rest = data[:at], data[at:]
    begin = _BEGIN.match(prolog)
    if at < 0 or not begin or b"<!" in prolog or prolog.count(b"<?") > bool(begin["says"]) or _A_ROW.search(prolog) or not _is_utf8(begin["says"] or b""):
        raise _Unusual
    _well_formed(prolog + _CLOSE)
    while True:
        cut = rest.rfind(_END) + len(_END)
        if cut >= len(_END):
            chunk, rest = rest[:cut], rest[cut:]
            plain, done = _plain_rows(chunk, begin["root"], shared), []
            if plain is not None:
                row_no, kept, cells = plain
                over = np.flatnonzero(row_no > last_row) if last_row is not None else []
                done = over[:1]
                wanted = (row_no[kept] >= first_row) & (kept < (over[0] if len(over) else len(row_no)))
                yield (row_no[kept], cells) if wanted.all() else (row_no[kept][wanted], cells.filter(pa.array(wanted)))
            else:
                if b"<!" in chunk or b"<?" in chunk:
                    raise _Unusual
                try:
                    rows = [*_parsed_rows(io.BytesIO(prolog + chunk + _CLOSE), shared, first_row, last_row, done)]
                except ET.ParseError:
                    raise _Unusual from None
                yield _arrays(rows)
            if len(done):
                return
        elif len(rest) > LONGEST_ROW:
            raise _Unusual
        block = fh.read(CHUNK_BYTES)
        if not block:
            break
        rest += block
    if _A_ROW.search(rest):
        raise _Unusual
    _well_formed(prolog + rest)


def _is_utf8(says: bytes) -> bool:
    return b"encoding" not in says or re.search(rb"""encoding\s*=\s*["']utf-?8["']""", says, re.I) is not None


def _well_formed(xml: bytes) -> None:
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        raise _Unusual from None
    if _tag(root.tag) != "worksheet" or not any(_tag(e.tag) == "sheetData" for e in root):
        raise _Unusual


def sheet_rows_of(opened, shared: list[str], first_row: int = 1, last_row: int | None = None, batch_rows: int = 20_000):
    """Batches (row numbers, cells) of the wanted rows that have values. ``opened()``: the
    sheet's XML opened for reading. A sheet lists its rows in ascending order, so parsing
    ends with the last wanted one."""
    n = 0
    try:
        with opened() as fh:
            for row_no, cells in _by_chunks(fh, shared, first_row, last_row):
                n += len(row_no)
                if len(row_no):
                    yield row_no, cells
        return
    except _Unusual:
        pass
    with opened() as fh:
        rows = []
        for row in _parsed_rows(fh, shared, first_row, last_row, []):
            if n:  # given already
                n -= 1
                continue
            rows.append(row)
            if len(rows) >= batch_rows:
                yield _arrays(rows)
                rows = []
        if rows:
            yield _arrays(rows)
