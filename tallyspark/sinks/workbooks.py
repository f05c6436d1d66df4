"""Sheet rows -> .xlsx files, the input form of every desktop flow. A minimal
standard-library writer (values only); a workbook is written by one task, as its rows
come. A sheet is bounded by the format itself (1,048,576 rows); what doesn't fit is an
error or, where asked for, goes on in further sheets of the workbook."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from contextlib import contextmanager
from functools import lru_cache
from itertools import groupby
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.xlsx import NS_LONG, _local

MAX_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_MARKS = "http://schemas.openxmlformats.org/markup-compatibility/2006"
_TEXT = ['" t="inlineStr"><is><t>', '" t="inlineStr"><is><t xml:space="preserve">']
PIECE_BYTES = 8 << 20
LEVEL = 5  # of deflate: as small as zlib's usual 6 for such XML, in two thirds of its time


def _quoted(text: str) -> str:
    return escape(text, {'"': "&quot;"})


def column_name(i: int) -> str:
    """0 -> A, 26 -> AA."""
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


@lru_cache(maxsize=64)
def _cell_starts(n: int):
    import pyarrow as pa
    return pa.array([f'<c r="{column_name(i)}' for i in range(n)])


def _escaped(values):
    import pyarrow.compute as pc
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        if pc.any(pc.match_substring(values, raw)).as_py():
            values = pc.replace_substring(values, raw, shown)
    return values


def _spaced(values):
    """Which values begin or end with white space."""
    ends, data = (np.frombuffer(values.buffers()[i] or b"", t) for i, t in ((1, np.int32), (2, np.uint8)))
    ends = ends[values.offset:values.offset + len(values) + 1]
    first, last = ends[:-1], ends[1:] - 1
    out = np.zeros(len(values), bool)
    some = np.flatnonzero(first <= last)
    out[some] = (data[first[some]] <= 32) | (data[last[some]] <= 32)
    return out


def _rows_xml(row_nos, cells):
    """The XML of rows (Arrow: numbers, lists of texts) in pieces; every value is inline
    text. It is made for all cells of a piece at once."""
    import pyarrow as pa
    import pyarrow.compute as pc
    values, n = cells.flatten(), len(cells)
    if n > 1 and 6 * values.nbytes + 100 * len(values) > PIECE_BYTES:
        yield from _rows_xml(row_nos[:n // 2], cells[:n // 2])
        yield from _rows_xml(row_nos[n // 2:], cells[n // 2:])
        return
    length = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n, dtype=np.int32), length)
    col = np.arange(len(values), dtype=np.int32) - np.repeat(np.cumsum(length) - length, length).astype(np.int32)
    if values.null_count:
        there = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
        values, row, col = values.drop_null(), row[there], col[there]
    numbers = pc.fill_null(row_nos.cast(pa.string()), "None")
    spaced = _spaced(values)
    text = pa.array(_TEXT).take(pa.array(spaced.astype(np.int8))) if spaced.any() else pa.scalar(_TEXT[0])
    starts = _cell_starts(1 << int(col.max(initial=0)).bit_length()).take(pa.array(col))
    parts = pc.binary_join_element_wise(starts, numbers.take(pa.array(row)), text, _escaped(values), "</t></is></c>", "")
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=ends[1:])
    inner = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), parts), "")
    rows = pc.binary_join_element_wise('<row r="', numbers, '">', inner, "</row>", "")
    yield rows.buffers()[2] if n else b""


class _Book:
    """A workbook written to an open stream as its rows come: each sheet's in ascending
    order, sheet after sheet in workbook order. Where ``goes_on``, rows beyond a sheet's
    limit stand in further sheets, marked in workbook.xml with the sheet they continue
    and the rows before; else they are an error."""

    def __init__(self, out, name: str = "", goes_on: bool = False):
        self.z, self.name, self.goes_on = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL), name, goes_on
        self.sheets, self.part, self.n_rows, self.n_sheet = [], None, 0, 0  # sheets: (sheet, rows before), one a part

    def add(self, sheet: str, row_nos, cells) -> None:
        """Some rows of a sheet, as Arrow arrays of numbers and of lists of texts."""
        import pyarrow.compute as pc
        if not self.goes_on:
            return self._add(sheet, 0, row_nos, cells)
        numbers = row_nos.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.where(numbers > MAX_ROWS, (numbers - 1) // MAX_ROWS * MAX_ROWS, 0)
        cuts = [0, *(np.flatnonzero(before[1:] != before[:-1]) + 1).tolist(), len(numbers)]
        for lo, hi in zip(cuts, cuts[1:]):
            while lo < hi:  # numbers that come twice can fill a part
                here = self.part is not None and self.sheets[-1] == (sheet, before[lo]) and self.n_sheet < MAX_ROWS
                n = min(hi - lo, MAX_ROWS - self.n_sheet * here)
                some = row_nos[lo:lo + n]
                self._add(sheet, int(before[lo]), pc.subtract(some, int(before[lo])) if before[lo] else some, cells[lo:lo + n])
                lo += n

    def _add(self, sheet, before, row_nos, cells) -> None:
        if self.part is None or self.sheets[-1] != (sheet, before) or self.goes_on and self.n_sheet >= MAX_ROWS:
            self._end_sheet()
            self.sheets.append((sheet, before))
            self.part = self.z.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True)
            self.part.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            self.n_sheet = 0
        self.n_sheet += len(row_nos)
        if self.n_sheet > MAX_ROWS:
            raise ValueError(f"{self.name}: a sheet holds more than {MAX_ROWS} rows")
        self.n_rows += len(row_nos)
        for xml in _rows_xml(row_nos, cells):
            self.part.write(xml)

    def _named(self):
        """(name, the marks of one that goes on) of each sheet."""
        used = {s.lower() for s, _ in self.sheets}
        seen, out = set(), []
        for sheet, before in self.sheets:
            name, k = sheet, 2
            while sheet in seen and name.lower() in used:
                name, k = f"{sheet[:31 - len(f'~{k}')]}~{k}", k + 1
            used.add(name.lower())
            first = sheet not in seen
            seen.add(sheet)
            mark = (f' long:continues="{_quoted(sheet)}"' if not first else "") + (f' long:rowsBefore="{before}"' if before else "")
            out.append((_quoted(name), mark))
        return out

    def _end_sheet(self) -> None:
        if self.part is not None:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()

    def close(self) -> None:
        self._end_sheet()
        n, z = range(1, len(self.sheets) + 1), self.z
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_KIND}.worksheet+xml"/>' for k in n)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.'
                   f'relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" '
                   'Target="xl/workbook.xml"/></Relationships>')
        named = self._named()
        names = "".join(f'<sheet name="{name}" sheetId="{k}" r:id="rId{k}"{mark}/>' for k, (name, mark) in zip(n, named))
        long = f' xmlns:mc="{_MARKS}" xmlns:long="{NS_LONG}" mc:Ignorable="long"' if any(mark for _, mark in named) else ""
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"{long}><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_DOC}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PKG}/relationships">{links}</Relationships>')
        z.close()


def workbook_bytes(sheets: dict) -> bytes:
    """``sheets``: name -> [(row_no, cells)], in workbook order."""
    import pyarrow as pa
    out = io.BytesIO()
    book = _Book(out)
    for sheet, rows in sheets.items():
        book.add(sheet, pa.array([r for r, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string())))
    book.close()
    return out.getvalue()


@contextmanager
def _drafted(folder: str, name: str):
    """(stream, path) of a file written under a name that scans skip, and renamed once
    it is whole; of one that isn't nothing is left."""
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        draft = f"{local}/_{name}.{uuid.uuid4().hex}"
        try:
            with open(draft, "wb") as fh:
                yield fh, f"file:{local}/{name}"
            os.replace(draft, f"{local}/{name}")
        except BaseException:
            if os.path.exists(draft):
                os.remove(draft)
            raise
        return
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/_{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(draft) as fh:
            yield fh, f"{folder}/{name}"
        system.move(draft, f"{path}/{name}")
    except BaseException:
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_file(draft)
        raise


def _put(folder: str, name: str, content: bytes) -> str:
    with _drafted(folder, name) as (fh, path):
        fh.write(content)
    return path


def _runs(batches):
    """(file_name, sheet, row numbers, cells): the rows of one sheet that stand together
    in an Arrow batch."""
    import pyarrow as pa
    for batch in batches:
        n, (names, sheets, row_nos, cells) = len(batch), (batch.column(c) for c in ("file_name", "sheet", "row_no", "cells"))
        new = np.zeros(n, bool)
        for column in (names, sheets):
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        row_nos, cells = row_nos.cast(pa.int64()), cells.cast(pa.list_(pa.string()))
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                yield names[lo].as_py(), sheets[lo].as_py(), row_nos[lo:hi], cells[lo:hi]


def write_workbooks(rows: DataFrame, folder: str, goes_on: bool = False) -> DataFrame:
    """Writes ``rows(file_name, sheet, row_no, cells)`` as ``<folder>/<file_name>.xlsx``
    and gives (path, n_rows) of what is written. A workbook appears whole or not at
    all, and one that is written again (a lost executor) is the same. Its rows come
    sorted and are written as they come, so a task holds one batch of them. A sheet of
    more rows than the format holds is an error, or goes on in further sheets that the
    scan takes as one (``goes_on``; then none has a row number beyond the format's)."""
    def run(batches):
        import pyarrow as pa
        for name, parts in groupby(_runs(batches), key=lambda r: r[0]):
            with _drafted(folder.rstrip("/"), f"{name}.xlsx") as (fh, path):
                book = _Book(fh, name, goes_on)
                for _, sheet, row_nos, cells in parts:
                    book.add(sheet, row_nos, cells)
                book.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_rows": [book.n_rows]})

    used = rows.where(F.exists("cells", lambda v: v.isNotNull()))  # a row without values isn't stored
    order = ["file_name", "sheet", "row_no", "cells"]
    return used.select(*order).repartition("file_name").sortWithinPartitions(*order).mapInArrow(run, "path string, n_rows long")
