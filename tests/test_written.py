"""Scans and sinks: what is pushed, what readers find, what a failed write leaves."""

import contextlib
import io
import os
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import rows_of
from tallyspark.operators import balances as B
from tallyspark.operators import papers as P
from tallyspark.sinks import writers as W
from tallyspark.sinks.workbooks import column_name, workbook_bytes, write_workbooks
from tallyspark.sources import files as FS
from tallyspark.sources import stack as S
from tallyspark.sources import xlsx as XS

CELLS = "file_name string, sheet string, row_no int, col_no int, value string"


def plan_of(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture()
def workbooks(spark, scratch):
    rows = [(f, s, r, [f, None, f"{s}{r}", 'a<&>"é'] if r % 2 else [None, str(r)]) for f in ("甲", "乙 丙") for s in ("CF2", "8_费用", "1") for r in range(1, 40)]
    df = spark.createDataFrame(rows, "file_name string, sheet string, row_no int, cells array<string>")
    write_workbooks(df, scratch).collect()
    return scratch, rows


def test_workbooks_come_back(spark, workbooks):
    folder, rows = workbooks
    back = XS.scan_workbook_cells(spark, folder)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert [column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert list(XS.parse_workbook(workbook_bytes({"s": [(2, ["x"]), (9, [None, " y "])]}))) == [("s", 0, 2, ["x"]), ("s", 0, 9, [None, " y "])]


def test_sheet_and_row_filters_reach_the_scan(spark, workbooks):
    folder, rows = workbooks
    scan = lambda: XS.read_workbooks(spark, folder, once=True)
    got = scan().where("sheet in ('CF2', '1') and row_no > 4 and row_no <= 7 and file_name = '甲'")
    text = plan_of(got)
    assert "In(sheet" in text and "GreaterThan(row_no,4)" in text and "LessThanOrEqual(row_no,7)" in text
    assert got.rdd.getNumPartitions() == 4  # a partition for each workbook and sheet
    assert rows_of(got, "file_name", "sheet", "row_no") == sorted(r[:3] for r in rows if r[0] == "甲" and r[1] in ("CF2", "1") and 4 < r[2] <= 7)
    assert scan().rdd.getNumPartitions() == 2
    assert scan().where("sheet = 'CF2' and sheet = '1'").count() == 0 and scan().where("row_no = 40").count() == 0
    assert XS.scan_workbook_cells(spark, folder, ["8_费用"], once=True).where("sheet = 'CF2'").count() == 0


def test_one_load_may_be_filtered_in_many_ways(spark, workbooks):
    folder, rows = workbooks
    scan = XS.read_workbooks(spark, folder)
    a, b = scan.where("sheet = 'CF2'"), scan.where("sheet = '1' and row_no <= 2")
    assert a.union(b).union(scan).count() == 2 * 39 + 2 * 2 + len(rows)
    named = XS.read_workbooks(spark, folder, sheets=["CF2", "nowhere"], first_row=5, last_row=6)
    assert named.rdd.getNumPartitions() == 4 and named.where("error is null").count() == 4 and named.where("error is not null").count() == 0


def test_rows_beyond_the_last_wanted_one_are_not_parsed():
    broken = workbook_bytes({"s": [(i, [str(i)]) for i in range(1, 9)]})
    import zipfile
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(broken)) as z, zipfile.ZipFile(out, "w") as w:
        for n in z.namelist():
            data = z.read(n)
            w.writestr(n, data.replace(b'<row r="7">', b'<row r="7"><<<') if "sheet1" in n else data)
    assert [r[2] for r in XS.parse_workbook(out.getvalue(), None, 3, 5)] == [3, 4, 5]
    with pytest.raises(Exception):
        list(XS.parse_workbook(out.getvalue()))


def test_a_broken_workbook_gives_an_error_row_and_no_rows(spark, workbooks):
    folder, rows = workbooks
    with open(os.path.join(folder, "坏.xlsx"), "wb") as fh:
        fh.write(b"junk")
    table = os.path.join(folder, "rows")
    XS.ingest_workbooks(spark, folder, table)
    assert XS.sheet_rows(spark, table).count() == len(rows)
    assert [r.file_name for r in XS.sheet_rejects(spark, table).collect()] == ["坏"]
    assert XS.scan_rejects(spark, folder, ["nowhere"]).count() == 3
    files = spark.read.parquet(table + "_files")
    assert files.count() == 3 and files.where("error is null").count() == 2


def test_one_base_name_in_two_folders(spark, scratch):
    df = spark.createDataFrame([("a", "s", 1, ["x"])], "file_name string, sheet string, row_no int, cells array<string>")
    for sub in ("p", "q"):
        write_workbooks(df, f"{scratch}/{sub}").collect()
    names = {r.file_name for r in XS.scan_workbook_cells(spark, scratch).collect()}
    assert len(names) == 2 and all(n.endswith("/a") for n in names)


def test_a_workbook_leaves_the_task_as_its_rows_come(spark, scratch, monkeypatch):
    import pyarrow as pa

    import tallyspark.sinks.workbooks as W
    got = {}

    def batches():
        for b in range(20):
            got[b] = sum(os.path.getsize(os.path.join(scratch, f)) for f in os.listdir(scratch)) if os.path.isdir(scratch) else 0
            yield pa.RecordBatch.from_pydict({"file_name": ["f"] * 1000, "sheet": ["s"] * 1000, "row_no": list(range(b * 1000, b * 1000 + 1000)),
                                              "cells": [[os.urandom(50).hex()] for _ in range(1000)]})

    run = {}
    df = spark.createDataFrame([("f", "s", 1, ["x"])], "file_name string, sheet string, row_no int, cells array<string>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, fn, schema: run.setdefault("fn", fn))
    write_workbooks(df, scratch)
    out, = run["fn"](batches())
    assert out.to_pydict() == {"path": [f"file:{scratch}/f.xlsx"], "n_rows": [20_000]}
    assert got[15] > 10 * 50 * 1000  # most of the earlier batches are in the file already
    monkeypatch.setattr(W, "MAX_ROWS", 15_000)
    with pytest.raises(ValueError):
        list(run["fn"](batches()))
    assert os.listdir(scratch) == ["f.xlsx"]  # no draft is left


def test_a_sheet_in_parsing_is_not_held_in_memory(scratch, monkeypatch):
    import pyarrow as pa
    os.makedirs(scratch, exist_ok=True)
    path = os.path.join(scratch, "big.xlsx")
    with open(path, "wb") as fh:
        fh.write(workbook_bytes({"s": [(i, [f"{i:0200d}"]) for i in range(1, 20_001)]}))
    monkeypatch.setattr(XS, "OUT_CHUNK_ROWS", 1000)
    monkeypatch.setattr(XS, "SPOOL_BYTES", 1000, raising=False)
    before = pa.total_allocated_bytes()
    read = XS.WorkbookReader({"path": path}).read(XS.SheetUnit(f"file:{path}", None, None, True))
    first = next(read)
    assert pa.total_allocated_bytes() - before < 2_000_000  # of 4,000,000 and more
    assert first.num_rows + sum(b.num_rows for b in read) == 20_000


# --- replaced tables ---------------------------------------------------------

def failing(spark):
    return spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("v"))


def test_a_failed_replacement_leaves_the_first_table(spark, scratch):
    one, two = spark.range(3).toDF("v"), spark.range(5).toDF("v")
    for target in (f"{scratch}/t", f"replaced_{os.path.basename(scratch).replace('-', '_')}"):
        W.replace_table(one, target)
        with pytest.raises(Exception):
            W.replace_table(failing(spark), target)
        read = lambda: spark.read.parquet(target) if "/" in target else spark.table(target)
        assert read().count() == 3
        before = read()  # a reader that has begun
        W.replace_table(two, target)
        assert read().count() == 5
        if "/" not in target:
            assert before.count() == 3
            W.replace_table(spark.createDataFrame([("other",)], "name string"), target)
            assert spark.table(target).columns == ["name"]
            W.drop_versions(spark, target)
            assert spark.table(target).count() == 1
            spark.sql(f"DROP VIEW {target}")
    assert sorted(os.listdir(scratch)) == ["t"]  # nothing is left beside it


def test_published_versions(spark, scratch):
    target = f"{scratch}/p"
    with pytest.raises(ValueError):
        W.published(spark, target)
    assert W.publish(spark.range(3).toDF("v"), target) == 1
    with pytest.raises(Exception):
        W.publish(failing(spark), target)
    assert W.published(spark, target).count() == 3
    reader = W.published(spark, target)
    assert W.publish(spark.range(7).toDF("v"), target) == 2
    assert W.published(spark, target).count() == 7 and W.published(spark, target, 1).count() == 3 == reader.count()


# --- parts -------------------------------------------------------------------

def test_parts_and_their_manifest(spark, scratch):
    df = spark.createDataFrame([("007", 1), ("B", 2), ("007", 3)], "company string, v int")
    names = spark.createDataFrame([("007",), ("empty",), (None,)], "company string")
    manifest = W.write_parts(df, f"{scratch}/parts", expected=names)
    assert {r.part: (r.n_rows, r.n_files > 0) for r in manifest.collect()} == {"007": (2, True), "B": (1, True), "empty": (0, False)}
    one = W.read_parts(spark, f"{scratch}/parts", df.schema, parts=["007"])
    assert rows_of(one, "company", "v") == [("007", 1), ("007", 3)]
    text = plan_of(one)
    assert "PartitionFilters" in text and "company_part" in text.split("PartitionFilters")[1].splitlines()[0]
    assert W.read_parts(spark, f"{scratch}/parts", df.schema, parts=["empty"]).count() == 0


def test_parts_take_no_task_for_each_folder(spark, scratch):
    df = spark.range(3000).select(F.concat(F.lit("C"), F.col("id") % 300).alias("company"), "id")
    sc = spark.sparkContext
    sc.setJobGroup(scratch, "parts")
    try:
        manifest = W.write_parts(df, f"{scratch}/parts")
        back = W.read_parts(spark, f"{scratch}/parts", df.schema)
    finally:
        sc.setJobGroup("", "")
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(scratch)]
    assert sum(sc.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds) < 300
    assert {(r.n_rows, r.n_files) for r in manifest.collect()} == {(10, 1)} and manifest.count() == 300
    assert rows_of(back, "id") == [(i,) for i in range(3000)]


def test_parts_of_any_name_and_size(spark, scratch, monkeypatch):
    monkeypatch.setattr(W, "MAX_RECORDS_PER_FILE", 7)
    names = ["a/b", "x=1", "50% #?", "甲:乙", "", None, "__HIVE_DEFAULT_PARTITION__", "007", "{[^]}'\"\\*"]
    rows = [(n, i) for i in range(60) for n in names]
    df = spark.createDataFrame(rows, "company string, v int")
    for _ in range(2):  # the second write replaces the first
        manifest = W.write_parts(df, f"{scratch}/parts")
    read = W.read_parts(spark, f"{scratch}/parts", df.schema)
    assert Counter(map(tuple, read.select("company", "v").collect())) == Counter(rows)
    assert {r.part: r.n_rows for r in manifest.groupBy("part").agg(F.sum("n_rows").alias("n_rows")).collect()} == {
        n: 180 if n is None else 60 for n in names if n and n != "__HIVE_DEFAULT_PARTITION__"} | {None: 180}
    assert all(r.n_files >= 9 for r in manifest.collect())
    assert W.read_parts(spark, f"{scratch}/parts", df.schema, parts=["a/b"]).count() == 60


def test_log_of_the_last_run_of_each_company(spark, scratch):
    log = lambda rows: spark.createDataFrame(rows, "company string, acct_code string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "company string")
    path = f"{scratch}/log"
    W.write_recon_log(log([("A", "1"), ("B", "2"), ("C", "3")]), path, run=1, companies=names("A", "B", "C", "D"))
    W.write_recon_log(log([("A", "9"), ("A", "8")]), path, run=2, companies=names("A", "B"))  # B agrees now
    W.write_recon_log(log([]), path, run=3, companies=names("D"))
    assert rows_of(W.read_recon_log(spark, path), "company", "acct_code", "run") == [("A", "8", 2), ("A", "9", 2), ("C", "3", 1)]


# --- stacks ------------------------------------------------------------------

def test_stacks_of_unlike_files(spark, scratch):
    put = lambda name, text: open(os.path.join(scratch, name), "w", encoding="utf-8").write(text)
    put("a.csv", 'x,y\n1,"two\nlines"\n2,\n')
    put("b.csv", "y,z,y\n3,4,5\n")
    put("c.csv", "x,y\n6,7\n")
    put("empty.csv", "")
    got = S.stack_csv(spark, scratch).withColumn("f", S.base_file(S.FILE_COL))
    assert got.columns == [S.FILE_COL, "x", "y", "z", "y.1", "f"]
    assert rows_of(got.select("f", "x", "y", "z", F.col("`y.1`").alias("w")), "f", "x", "y", "z", "w") == sorted(
        [("a", "1", "two\nlines", None, None), ("a", "2", None, None, None), ("b", None, "3", "4", "5"), ("c", "6", "7", None, None)],
        key=lambda t: tuple((True, 0) if x is None else (False, x) for x in t))
    for i, cols in enumerate((["x"], ["x", "z"])):
        spark.range(2).select(*[F.col("id").alias(c) for c in cols]).write.parquet(f"{scratch}/pq/{i}")
    both = S.stack_parquet(spark, f"{scratch}/pq")
    assert both.columns == [S.FILE_COL, "x", "z"] and both.where("z is null").count() == 2
    assert S.unique_names(["a", " ", "a", "a.1", "a"]) == ["a", "Unnamed: 1", "a.1", "a.1.1", "a.2"]


def test_ledger_lines_that_do_not_fit(spark, scratch):
    with open(f"{scratch}/l.csv", "w", encoding="utf-8") as fh:
        fh.write('公司代码,功能范围：文本,总账科目：短文本,凭证货币价值\nC1,a,"say ""x"", or\ny",1.00\nC2,a,b\nC3,a,b,2.00,extra\nC4,,,\n')
    assert rows_of(FS.read_ledger_csv(spark, scratch), "company_code", "gl_text") == [("C1", 'say "x", or\ny'), ("C4", None)]
    assert rows_of(FS.ledger_csv_rejects(spark, scratch), "first_field", "line") == [("C2", "C2,a,b"), ("C3", "C3,a,b,2.00,extra")]


# --- checks ------------------------------------------------------------------

def test_single_sheet_metrics_and_failing_mode(spark):
    row = [["t"]] * 4 + [["1001", "cash", "借", "1.00"], ["合计"]]
    rows = [("a", "s1", i + 1, c) for i, c in enumerate(row)] + [("b", s, i + 1, c) for s in ("s1", "s2") for i, c in enumerate(row)]
    df = spark.createDataFrame(rows, "file_name string, sheet string, row_no int, cells array<string>")
    seen = Observation()
    assert [r.company for r in B.read_balance_a(df, observation=seen).collect()] == ["a"]
    assert seen.get == {"files": 2, "sheets": 3, "violations": 1}
    with pytest.raises(Exception, match="more than one non-empty sheet: b"):
        B.read_balance_a(df, failing=True).collect()
    assert B.read_balance_a(df.where("file_name = 'a'"), failing=True).count() == 1


def brute_header(rows):
    """First of the rows with the fewest empty cells, the last row not eligible."""
    last, width = max(r for r, _ in rows), max(len(c) for _, c in rows)
    best = min(((width - sum(v is not None for v in c), r, c) for r, c in rows if r < last), default=None, key=lambda x: x[:2])
    return best and (best[1], best[2])


def test_header_pass_equals_the_rule(spark):
    import random
    rng = random.Random(4)
    sheets = {f"f{i}": [(r, [rng.choice([None, f"v{rng.randrange(5)}"]) for _ in range(rng.randrange(1, 5))]) for r in sorted(rng.sample(range(1, 30), rng.randrange(1, 7)))]
              for i in range(120)}
    df = spark.createDataFrame([(f, "s", r, c) for f, rs in sheets.items() for r, c in rs], "file_name string, sheet string, row_no int, cells array<string>")
    want = []
    for f, rs in sheets.items():
        if (head := brute_header(rs)) is not None:
            want += [(f, r, (head[1][i] or None) if i < len(head[1]) else None, v) for r, c in rs if r > head[0] for i, v in enumerate(c) if v is not None]
    got = P.auto_header(df)
    assert sorted(map(str, (tuple(x) for x in got.select("file_name", "row_no", "col_name", "value").collect()))) == sorted(map(str, want))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan ExistingRDD") == 2  # one pass for the headers, one for the body


# --- positions ---------------------------------------------------------------

def test_offsets_of_a_hundred_thousand_files(spark, monkeypatch):
    n = 100_000
    counts = spark.range(n).select(F.format_string("f%06d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("file"), F.lit("t").alias("table"),
                                   (1 + F.col("id") % 5).alias("_n")).union(spark.createDataFrame([("z", "u", 3), ("a", "u", 2)], "file string, table string, _n long"))
    got = P.file_offsets(counts, "file", ["table"])
    rows = sorted((r["file"], r["_off"]) for r in got.where("table = 't'").collect())
    sizes = {r["file"]: r["_n"] for r in counts.where("table = 't'").collect()}
    at = 0
    for file, off in rows:
        assert off == at
        at += sizes[file]
    assert len(rows) == n and rows_of(got.where("table = 'u'"), "file", "_off") == [("a", 0), ("z", 2)]
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(table" not in text.split("_range")[0]


# --- papers ------------------------------------------------------------------

def test_only_papers_with_updates_are_rewritten(spark, scratch):
    path = f"{scratch}/papers"
    cells = spark.createDataFrame([(f, "s", r, 0, f"{f}{r}") for f in ("p1", "p2", "p3") for r in range(1, 4)], CELLS)
    W.write_per_company(cells, path, by="file_name")
    stamp = lambda: {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if "=" in d}
    before = stamp()
    up = spark.createDataFrame([("p2", "s", 2, 0, "new", 1), ("p2", "s", 3, 0, None, 1), ("p2", "s", 1, 0, "a", 1), ("p2", "s", 1, 0, "b", 2), ("p9", "s", 1, 1, "x", 1)],
                               CELLS + ", seq int")
    P.update_papers(spark, path, up)
    after = stamp()
    assert {d for d in after if after[d] != before.get(d)} == {"file_name_part=p2", "file_name_part=p9"}
    got = {(r.file_name, r.row_no, r.col_no): r.value for r in spark.read.parquet(path).collect()}
    assert got["p2", 2, 0] == "new" and got["p2", 3, 0] is None and got["p2", 1, 0] == "b" and got["p9", 1, 1] == "x" and got["p1", 1, 0] == "p11"
    assert len(got) == 10


# --- sheets longer than the format's ------------------------------------------

LONG = "甲" * 30 + "z"


def long_book(spark, monkeypatch, folder, rows, limit, **how):
    """The path of the one workbook of ``rows`` (sheet, row_no, cells), a sheet of which holds ``limit`` rows."""
    import pyarrow as pa

    import tallyspark.sinks.workbooks as W
    run = {}
    df = spark.createDataFrame([("f", "s", 1, ["x"])], "file_name string, sheet string, row_no int, cells array<string>")
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, fn, schema: run.setdefault("fn", fn))
        m.setattr(W, "MAX_ROWS", limit)
        write_workbooks(df, folder, **how)
        list(run["fn"](pa.RecordBatch.from_pydict({"file_name": ["f"] * len(some), "sheet": [r[0] for r in some], "row_no": [r[1] for r in some],
                                                   "cells": [r[2] for r in some]}) for some in (rows[i:i + 37] for i in range(0, len(rows), 37))))
    return f"{folder}/f.xlsx"


def test_a_sheet_beyond_the_limit_goes_on_in_further_sheets(spark, scratch, monkeypatch):
    import re
    import zipfile
    rows = ([(LONG, i, [str(i), None, "x"]) for i in range(1, 250)] + [(LONG, 249, [f"twice {k:03d}"]) for k in range(130)] + [("Z", 2_000_000_000, ["far"])]
            + [("a~2", i, [f"own {i}"]) for i in (1, 2)] + [("a", i, [f"a{i}"]) for i in (50, 150, 1_000)])
    with pytest.raises(ValueError):
        long_book(spark, monkeypatch, f"{scratch}/not", rows, 100)
    path = long_book(spark, monkeypatch, scratch, rows, 100, goes_on=True)
    idx = {LONG: 0, "Z": 1, "a~2": 2, "a": 3}
    back = lambda sheets=None, first=1, last=None: [*XS.parse_workbook(open(path, "rb").read(), sheets, first, last)]
    assert back() == [(s, idx[s], r, c) for s, r, c in rows]
    assert [r[2] for r in back([LONG], 95, 205)] == [*range(95, 206)] and [r[2] for r in back(["a"], 51)] == [150, 1_000] and back(["a"], 1, 49) == []
    reader = XS.WorkbookReader({"path": scratch, "sheets": '["a", "Z"]'})
    assert sorted(r for unit in reader.partitions() if "not" not in unit.uri for b in reader.read(unit) for r in b.column("row_no").to_pylist()) == [50, 150, 1_000, 2_000_000_000]
    with zipfile.ZipFile(path) as z:
        names = re.findall(r'<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
        parts = [[int(r) for r in re.findall(rb'<row r="(\d+)"', z.read(n))] for n in z.namelist() if n.startswith("xl/worksheets/")]
    assert len(names) == len(set(names)) == len(parts) == 9 and max(map(len, names)) <= 31
    assert max(max(p) for p in parts) <= 100 and max(map(len, parts)) <= 100


def test_the_scans_papers_hold_no_row_beyond_the_format(spark, scratch):
    import glob
    import re
    import zipfile

    from tallyspark.plans.written import q_scan_workbook_cells
    n = spark.range(1, 4_000_000, 1_000_000)
    n.selectExpr("id AS o_orderkey", "id % 2 AS o_custkey", "CAST(1 AS DOUBLE) AS o_totalprice", "'O' AS o_orderstatus", "'p' AS o_orderpriority").write.parquet(f"{scratch}/orders.parquet")
    spark.range(2).selectExpr("id AS c_custkey", "'c' AS c_name", "7L AS c_nationkey", "CAST(1 AS DOUBLE) AS c_acctbal").write.parquet(f"{scratch}/customer.parquet")
    before = set(glob.glob(spark.conf.get("spark.checkpoint.dir").replace("file:", "") + "/workbooks-*"))
    got = q_scan_workbook_cells(spark, scratch)
    assert {r.row_no for r in got.where("row_no > 4").collect()} == {1 + k * 1_000_000 + 10 for k in range(4)}
    folder, = set(glob.glob(spark.conf.get("spark.checkpoint.dir").replace("file:", "") + "/workbooks-*")) - before
    with zipfile.ZipFile(f"{folder}/7.xlsx") as z:
        assert max(int(r) for name in z.namelist() if "worksheets" in name for r in re.findall(rb'<row r="(\d+)"', z.read(name))) <= 1_048_576
