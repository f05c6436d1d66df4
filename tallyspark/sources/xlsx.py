"""Workbook scan: many .xlsx files -> sheet rows, in parallel on the cluster.

``spark.read.format("workbook")`` is a Python data source: a partition is one sheet
of one workbook where sheets are named, else one workbook, and a sheet's XML isn't
parsed beyond the last wanted row. Workbooks are unzipped with the standard library;
cached values are read, not formulas. Unreadable files and missing sheets give no rows,
as in the source, but an ``error`` row, see :func:`scan_rejects`.

``format("workbook_once")`` is the same source with filters on ``sheet`` and ``row_no``
pushed into it. Spark 4.1 keeps the filters of a load's last plan with the load, not
with the plan: two differently filtered frames of one load in one query would both read
what the later one asked for. So this form is for a load that a query reads once.
"""

from __future__ import annotations

import ctypes
import io
import json
import os
import posixpath
import tempfile
import zipfile
from collections import Counter
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
                                    LessThan, LessThanOrEqual)

from tallyspark.sources.sheet_xml import sheet_rows_of

SCAN_SCHEMA = ("path string, file_name string, sheet string, sheet_idx int, row_no int, cells array<string>, "
               "error string")

_NS_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
NS_LONG = "urn:tallyspark:long-sheets"  # of the marks of a sheet that goes on in further ones
_CONTINUES, _ROWS_BEFORE = f"{{{NS_LONG}}}continues", f"{{{NS_LONG}}}rowsBefore"


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    try:
        data = z.read("xl/sharedStrings.xml")
    except KeyError:
        return []
    out = []
    for si in ET.fromstring(data).iterfind("{*}si"):
        # plain <t> or rich-text runs <r><t>
        out.append("".join(t.text or "" for t in si.iterfind(".//{*}t")))
    return out


def _sheet_targets(z: zipfile.ZipFile) -> dict[str, list[tuple[str, int]]]:
    """Sheet name -> its parts' paths, resolved through workbook.xml and its rels, each
    with what is added to its row numbers: a sheet that goes on in further ones (see
    ``sinks.workbooks``) has several."""
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    by_id = {}
    for r in rels.iterfind("{*}Relationship"):
        tgt = r.get("Target", "")
        tgt = tgt.lstrip("/") if tgt.startswith("/") else posixpath.normpath(posixpath.join("xl", tgt))
        by_id[r.get("Id")] = tgt
    out, further = {}, []
    for s in wb.iterfind(".//{*}sheets/{*}sheet"):
        rid = s.get(_NS_REL)
        if rid in by_id:
            if s.get(_CONTINUES) is None:
                out[s.get("name")] = [(by_id[rid], int(s.get(_ROWS_BEFORE, 0)))]
            else:
                further.append((s.get(_CONTINUES), by_id[rid], int(s.get(_ROWS_BEFORE, 0))))
    for name, part, before in further:
        out[name].append((part, before))
    return out


def parse_batches(content, sheets=None, first_row: int = 1, last_row: int | None = None, batch_rows: int | None = None):
    """Yield ``(sheet, sheet_idx, row_nos, cells)`` for the wanted sheets (all
    if None) and rows of a workbook (its bytes or an open file), some rows at a time:
    their numbers (NumPy) and cells (Arrow); ``sheet_idx`` is the sheet's position in the workbook.
    Row and column numbers come from the cell references, not from
    counting, so empty cells and rows are simply absent. A sheet lists its rows
    in ascending order, so parsing ends with the last wanted one."""
    n = 0
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as z:
        shared = _shared_strings(z)
        targets = _sheet_targets(z)
        for idx, (name, parts) in enumerate(targets.items()):
            if sheets is not None and name not in sheets:
                continue
            for part, before in parts:
                if before and last_row is not None and last_row <= before:
                    break
                last = None if last_row is None else last_row - before
                for row_nos, cells in sheet_rows_of(lambda: z.open(part), shared, first_row - before, last, batch_rows or OUT_CHUNK_ROWS):  # noqa: B023
                    yield name, idx, row_nos + before, cells
                    n += 1
                    if n % 64 == 0:
                        _release_unused()


def _release_unused() -> None:
    """The parser's passing arrays leave more and more of a worker's heap unused: glibc
    gives that back when told to."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def parse_workbook(content, sheets=None, first_row: int = 1, last_row: int | None = None):
    """The rows of :func:`parse_batches` one by one, ``(sheet, sheet_idx, row_no, cells)``."""
    for name, idx, row_nos, cells in parse_batches(content, sheets, first_row, last_row):
        for rn, row in zip(row_nos.tolist(), cells.to_pylist()):
            yield name, idx, rn, row


def _file_name(path: str, suffixes=(".xlsx", ".xlsm", ".xls")) -> str:
    base = posixpath.basename(path.replace("\\", "/"))
    for s in suffixes:
        if base.endswith(s):
            return base[: -len(s)]
    return base


OUT_CHUNK_ROWS = 20_000
SPOOL_BYTES, READ_BYTES = 8 << 20, 1 << 20
_COLS = ["path", "file_name", "sheet", "sheet_idx", "row_no", "cells", "error"]


def _scan_batches(sheets, chunk_rows: int = OUT_CHUNK_ROWS):
    """Arrow batches of (path, content) -> sheet rows. A workbook's rows are
    kept only if the whole workbook parses (an unreadable file gives no rows,
    only an error row); output frames are cut into chunks of at most
    ``chunk_rows`` rows. The sheet XML itself is streamed with iterparse."""
    def fn(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                fname = _file_name(path)
                try:
                    rows = [(path, fname, sheet, idx, rn, cells, None)
                            for sheet, idx, rn, cells in parse_workbook(bytes(content), sheets)]
                    if not rows:
                        rows = [(path, fname, None, None, None, None, "no wanted sheet")]
                except Exception as e:  # noqa: BLE001 - unreadable file: report, do not fail the job
                    rows = [(path, fname, None, None, None, None, f"{type(e).__name__}: {e}")]
                for i in range(0, len(rows), chunk_rows):
                    yield pd.DataFrame(rows[i:i + chunk_rows], columns=_COLS)
    return fn


# ---------------------------------------------------------------------------
# The data source
# ---------------------------------------------------------------------------

@dataclass
class SheetUnit(InputPartition):
    """What one task reads: one sheet of a workbook, or all of its ``sheets``."""

    uri: str
    sheet: str | None
    sheets: tuple | None
    reports: bool  # this task reports the workbook's error


def _local(uri: str) -> str | None:
    """The path of a local file or folder, None for any other file system."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    return None if "://" in uri else uri


def _workbook_uris(root: str, recursive: bool, suffixes=(".xlsx", ".xlsm")) -> list[str]:
    """The workbooks of a folder (or the one file), by listing alone."""
    local = _local(root)
    if local is not None:
        found = [local] if os.path.isfile(local) else [os.path.join(d, f) for d, _, fs in os.walk(local) for f in fs
                                                       if recursive or os.path.samefile(d, local)]
        before = "file:"
    else:
        from pyarrow import fs
        system, path = fs.FileSystem.from_uri(root)
        info = system.get_file_info(path.rstrip("/"))
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=recursive))
        found, before = [i.path for i in infos if i.type == fs.FileType.File], root[:root.rindex(path)] if path in root else root.split("://")[0] + "://"
    return sorted(before + p for p in found if p.endswith(suffixes) and not posixpath.basename(p).startswith((".", "_")))


def _open(uri: str):
    """A file of the shared storage, opened for reading bytes."""
    local = _local(uri)
    if local is not None:
        from urllib.parse import unquote
        return open(local if os.path.exists(local) else unquote(local), "rb")
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class WorkbookSource(DataSource):
    """``format("workbook")``. Options: ``path``, ``sheets`` (JSON list, default all),
    ``first_row`` and ``last_row`` (default all), ``recursive`` (default true)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCAN_SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        sheets = options.get("sheets")
        self.sheets = None if sheets is None else tuple(json.loads(sheets))
        self.first_row = int(options.get("first_row", 1))
        self.last_row = int(options["last_row"]) if "last_row" in options else None
        self.pushed: tuple | None = None  # sheets of a filter
        self.filtered = False

    def partitions(self):
        names = self.sheets
        if self.pushed is not None:
            names = tuple(n for n in dict.fromkeys(self.pushed) if self.sheets is None or n in self.sheets)
        uris = _workbook_uris(self.root, self.recursive)
        if names is None:
            return [SheetUnit(u, None, None, True) for u in uris]
        return [SheetUnit(u, n, names, i == 0) for u in uris for i, n in enumerate(names)]

    def read(self, unit: SheetUnit | None):
        """Arrow batches; a sheet's rows leave only once it has parsed to its end, and
        wait for that in a file if they are many."""
        import pyarrow as pa
        if unit is None:  # no partition at all
            return
        schema = pa.schema([("path", pa.string()), ("file_name", pa.string()), ("sheet", pa.string()), ("sheet_idx", pa.int32()),
                            ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
        kept = pa.schema([schema.field("row_no"), schema.field("cells")])
        name, sheets_of = _file_name(unit.uri), []  # the sheet of each batch that waits

        def error(text):
            return pa.RecordBatch.from_pylist([{"path": unit.uri, "file_name": name, "error": text}], schema=schema)

        tells = unit.reports and not self.filtered
        with tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES) as spool:
            try:
                with pa.ipc.new_stream(spool, kept, options=pa.ipc.IpcWriteOptions(compression="zstd")) as done, _open(unit.uri) as fh:
                    content = io.BufferedReader(fh, READ_BYTES)
                    wanted = None if unit.sheet is None else [unit.sheet]
                    for sheet, idx, row_nos, cells in parse_batches(content, wanted, self.first_row, self.last_row):
                        batch = pa.RecordBatch.from_arrays([pa.array(row_nos).cast(pa.int32()), cells], schema=kept)
                        for i in range(0, len(batch), OUT_CHUNK_ROWS):
                            done.write_batch(batch.slice(i, OUT_CHUNK_ROWS))
                            sheets_of.append((sheet, idx))
                    if tells and not sheets_of:
                        with zipfile.ZipFile(content) as z:
                            found = set(_sheet_targets(z))
                        if unit.sheets is None or not found & set(unit.sheets):
                            yield error("no wanted sheet")
                            return
            except Exception as e:  # noqa: BLE001 - unreadable file: report, do not fail the job
                if tells:
                    yield error(f"{type(e).__name__}: {e}")
                return
            spool.seek(0)
            for (sheet, idx), batch in zip(sheets_of, pa.ipc.open_stream(spool)):
                n = len(batch)
                same = [pa.repeat(pa.scalar(v, t), n) for v, t in ((unit.uri, pa.string()), (name, pa.string()), (sheet, pa.string()), (idx, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, *batch.columns, pa.nulls(n, pa.string())], schema=schema)


class FilteredWorkbookSource(WorkbookSource):
    """``format("workbook_once")``: filters are pushed (see the module's note)."""

    @classmethod
    def name(cls) -> str:
        return "workbook_once"

    def reader(self, schema) -> FilteredWorkbookReader:
        return FilteredWorkbookReader(self.options)


class FilteredWorkbookReader(WorkbookReader):
    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("sheet",) and isinstance(f, (EqualTo, In)):
                names = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
                self.pushed = tuple(n for n in names if n is not None and (self.pushed is None or n in self.pushed))
            elif column == ("row_no",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first_row = max(self.first_row, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.last_row = top if self.last_row is None else min(self.last_row, top)
            else:
                yield f
                continue
            self.filtered = True  # never true of an error row, which has neither sheet nor row


def read_workbooks(spark: SparkSession, path: str, recursive: bool = True, sheets=None, first_row: int = 1,
                   last_row: int | None = None, once: bool = False) -> DataFrame:
    """Raw scan with an ``error`` column (one row per failed file). Flat mode
    reads only the folder itself. ``once``: the frame is read once in a query, so its
    filters are pushed."""
    source = FilteredWorkbookSource if once else WorkbookSource
    if once:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    r = spark.read.format(source.name()).option("recursive", str(recursive).lower()).option("first_row", first_row)
    if sheets is not None:
        r = r.option("sheets", json.dumps(list(sheets)))
    return (r if last_row is None else r.option("last_row", last_row)).load(path)


def scan_workbook_cells(spark: SparkSession, path: str, sheets=None, recursive: bool = True, first_row: int = 1,
                        last_row: int | None = None, once: bool = False) -> DataFrame:
    """Sheet rows ``(file_name, sheet, row_no, cells)`` of every workbook (A3), see
    :func:`read_workbooks`. Files of one base name in several folders get their whole
    path as name."""
    rows = read_workbooks(spark, path, recursive, sheets, first_row, last_row, once).filter(F.col("error").isNull())
    twice = _names_used_twice(_workbook_uris(path, recursive))
    name = F.when(F.col("file_name").isin(twice), _whole_name("path")).otherwise(F.col("file_name")) if twice else F.col("file_name")
    return rows.select(name.alias("file_name"), "sheet", "row_no", "cells")


def scan_rejects(spark: SparkSession, path: str, sheets=None, recursive: bool = True) -> DataFrame:
    return read_workbooks(spark, path, recursive, sheets).filter(F.col("error").isNotNull()).select("path", "file_name", "error")


def _names_used_twice(uris: list[str]) -> list[str]:
    return sorted(n for n, c in Counter(map(_file_name, uris)).items() if c > 1)


def _whole_name(path):
    return F.regexp_replace(path, r"\.(xlsx|xlsm|xls)$", "")


def ingest_workbooks(spark: SparkSession, folder: str, target: str, sheets=None, recursive: bool = True) -> None:
    """Parse every workbook of a folder once into a Parquet sheet-rows table
    partitioned by sheet; failed files are kept as rows with ``error`` set. Beside it
    stands ``<target>_files``, one row a workbook: its path, its name (the whole path
    where two folders hold one base name) and its error. A workbook with an error
    anywhere gives no rows.

    Flows read this table (:func:`sheet_rows`) instead of the live scan: a
    flow touches its input several times (per-file aggregates joined back),
    and re-reading Parquet is cheap and prunable, while re-running the
    Python parse is not."""
    read_workbooks(spark, folder, recursive, sheets).write.mode("overwrite").partitionBy("sheet").parquet(target)
    rows = spark.read.schema(SCAN_SCHEMA).parquet(target)
    _file_names(rows).write.mode("overwrite").parquet(_files_of(target))


def _files_of(table_path: str) -> str:
    return table_path.rstrip("/") + "_files"


def _file_names(rows: DataFrame) -> DataFrame:
    """(path, file_name, error), one row a workbook; names told apart."""
    files = rows.groupBy("path", "file_name").agg(F.max("error").alias("error"))
    twice = files.groupBy("file_name").count().where("count > 1").select("file_name", F.lit(True).alias("_twice"))
    out = files.join(twice, "file_name", "left")
    return out.select("path", F.when(F.col("_twice"), _whole_name("path")).otherwise(F.col("file_name")).alias("file_name"), "error")


def _files(spark: SparkSession, table_path: str) -> DataFrame:
    try:
        return spark.read.schema("path string, file_name string, error string").parquet(_files_of(table_path))
    except AnalysisException:  # a table that a stream still appends to
        return _file_names(spark.read.schema(SCAN_SCHEMA).parquet(table_path))


def sheet_rows(spark: SparkSession, table_path: str, sheets=None, with_index: bool = False,
               with_path: bool = False) -> DataFrame:
    """Sheet rows of an ingested table; a sheet filter prunes partitions.
    ``with_index`` keeps each sheet's workbook position (``sheet_idx``). The
    schema is given, so that sheets named ``01`` or ``8`` stay text. Names and
    failed files come from the table of files, one row each."""
    df = spark.read.schema(SCAN_SCHEMA).parquet(table_path).filter(F.col("error").isNull())
    if sheets is not None:
        df = df.filter(F.col("sheet").isin(list(sheets)))
    files = _files(spark, table_path).where("error is null").select("path", "file_name")
    cols = ["file_name", "sheet", "row_no", "cells"] + (["sheet_idx"] if with_index else []) + (["path"] if with_path else [])
    return df.drop("file_name").join(files, "path").select(*cols)


def sheet_rejects(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.schema(SCAN_SCHEMA).parquet(table_path).filter(F.col("error").isNotNull()).select("path", "file_name", "error").distinct()
