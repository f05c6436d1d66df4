
from tallyspark.operators import ledger as L
from tallyspark.operators import papers as P
from conftest import rows_of

CELLS = "file_name string, sheet string, row_no int, col_no int, value string"


def test_apply_updates_last_wins_null_clears_new_cell(spark):
    existing = spark.createDataFrame([("p", "s", 1, 0, "a"), ("p", "s", 2, 0, "b"), ("p", "s", 3, 0, "c")], CELLS)
    upd = spark.createDataFrame([("p", "s", 1, 0, "x", 1), ("p", "s", 1, 0, "y", 2), ("p", "s", 2, 0, None, 1),
                                 ("p", "s", 9, 1, "new", 1)], CELLS + ", seq int")
    out = rows_of(P.apply_cell_updates(existing, upd), "row_no", "col_no", "value")
    assert out == [(1, 0, "y"), (2, 0, None), (3, 0, "c"), (9, 1, "new")]


def test_append_block_shifts_rows_below_anchor(spark):
    target = spark.createDataFrame([("s", 8, 0, "hdr"), ("s", 9, 0, "blank"), ("s", 10, 0, "style"),
                                    ("s", 11, 0, "total"), ("t", 10, 0, "untouched")],
                                   "sheet string, row_no int, col_no int, value string")
    block = spark.createDataFrame([("s", 0, 0, "r0"), ("s", 1, 0, "r1"), ("s", 2, 0, "r2"), ("s", 2, 1, "v")],
                                  "sheet string, pos long, col_off int, value string")
    out = rows_of(P.append_block(target, block, "A9").filter("sheet = 's'"), "row_no", "col_no", "value")
    assert out == [(8, 0, "hdr"), (9, 0, "r0"), (10, 0, "r1"), (11, 0, "r2"), (11, 1, "v"),
                   (13, 0, "style"), (14, 0, "total")]


def test_block_positions_global_order(spark):
    df = spark.createDataFrame([("b", 5), ("a", 9), ("a", 3), ("c", 1)], "file_name string, row_no int")
    assert rows_of(P.block_positions(df), "file_name", "row_no", "pos") == [("a", 3, 0), ("a", 9, 1), ("b", 5, 2), ("c", 1, 3)]


def test_auto_header_fewest_nulls_last_row_excluded(spark):
    rows = spark.createDataFrame(
        [("f", "s", 1, ["title", None, None]), ("f", "s", 2, [" a ", "b", None]), ("f", "s", 3, ["1", "2", "3"]),
         ("f", "s", 4, ["4", "5", "6"])],
        "file_name string, sheet string, row_no int, cells array<string>")
    # rows 3 is complete and earlier than 4 (4 is last and not eligible) -> header row 3
    out = rows_of(P.auto_header(rows), "row_no", "col_name", "value")
    assert out == [(4, "1", "4"), (4, "2", "5"), (4, "3", "6")]


def test_read_range_locates_columns_by_header(spark):
    rows = spark.createDataFrame(
        [("f1", "s", 1, ["x", "a", "b"]), ("f1", "s", 2, ["x", "1", "2"]),
         ("f2", "s", 1, ["x", "b", "a"]), ("f2", "s", 2, ["x", "3", "4"]), ("f2", "s", 9, ["x", "out", "of range"])],
        "file_name string, sheet string, row_no int, cells array<string>")
    out = rows_of(P.read_range(rows, "s", "B1", "C5", names=["a", "b"]), "文件名", "a", "b")
    assert out == [("f1", "1", "2"), ("f2", "4", "3")]


def test_dynamic_offsets_match_documented_example(spark):
    summary = spark.createDataFrame([("c", a, f"g{i}", 1) for a, n in [("销售费用", 60), ("管理费用", 74), ("研发费用", 64)]
                                     for i in range(n)], "company string, func_area string, gl_text string, amount int")
    slots = spark.createDataFrame([("c", 60, 74, 64)], "company string, slots_0 int, slots_1 int, slots_2 int")
    plan = {r.func_area: (r.start_row, r.copy_row, r.rows_added) for r in L.dynamic_plan(summary, slots).collect()}
    assert plan == {"销售费用": (2, 60, 0), "管理费用": (68, 140, 0), "研发费用": (148, 210, 0)}
    more = summary.unionByName(spark.createDataFrame([("c", "销售费用", "zz", 1)], summary.schema))
    p2 = {r.func_area: r.start_row for r in L.dynamic_plan(more, slots).collect()}
    legacy = {r.func_area: r.start_row for r in L.dynamic_plan(more, slots, legacy_offsets=True).collect()}
    assert p2 == {"销售费用": 2, "管理费用": 69, "研发费用": 149}
    assert legacy["研发费用"] == 150   # the source adds the first block's extra row twice


def test_text_label_prefix(spark):
    from tallyspark.functions.exprs import as_text_label
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert rows_of(df.select(as_text_label("v").alias("v")), "v") == [("'a",), (None,)]



def test_short_rows_do_not_fail_under_ansi(spark):
    from tallyspark.operators import balances as B
    rows = spark.createDataFrame(
        [("f", "s", 1, ["a", "b", "c"]), ("f", "s", 2, ["1"])],
        "file_name string, sheet string, row_no int, cells array<string>")
    assert rows_of(P.read_range(rows, "s", "A1", "C2", names=["a", "c"]), "a", "c") == [("1", None)]
    hdr = spark.createDataFrame([("f", "s", 1, ["科目代码", "科目名称", "外币期初"]), ("f", "s", 2, ["1001"])],
                                "file_name string, sheet string, row_no int, cells array<string>")
    r = B.read_balance_b(hdr).first()
    assert (r.acct_code, r.acct_name, r.fc_opening) == ("1001", None, None)


def test_slot_counts_read_the_whole_column_by_default(spark):
    rows = spark.createDataFrame(
        [("c", "8_费用", r, ["销售费用"]) for r in (1, 2, 3, 4, 600, 601)] + [("c", "8_费用", 5, ["管理费用"])],
        "file_name string, sheet string, row_no int, cells array<string>")
    r = L.slot_counts(rows, max_row=600).first()
    assert (r.slots_0, r.slots_1, r.slots_2) == (3, -1, -2)
    assert L.slot_counts(rows).first().slots_0 == 4


def test_sheet_table_mangles_repeated_headers(spark):
    rows = spark.createDataFrame(
        [("g", "资产负债表", 1, ["公司名称", "期末余额", "年初余额", "期末余额", "年初余额", "期末余额"]),
         ("g", "资产负债表", 2, ["A", "1", "2", "3", "4", "5"])],
        "file_name string, sheet string, row_no int, cells array<string>")
    t = P.read_sheet_table(rows, "资产负债表")
    r = t.first()
    assert (r["期末余额"], r["期末余额.1"], r["期末余额.2"], r["年初余额.1"]) == ("1", "3", "5", "4")


def test_dynamic_layout_inserts_and_copies_rows(spark):
    cells = spark.createDataFrame([("c", 1, 0, "hdr"), ("c", 3, 0, "销售费用"), ("c", 5, 0, "管理费用"), ("c", 9, 0, "end")],
                                  "company string, row_no int, col_no int, value string")
    plan = spark.createDataFrame([("c", "销售费用", 3, 2), ("c", "管理费用", 7, 1), ("c", "研发费用", 100, 0)],
                                 "company string, func_area string, copy_row int, rows_added int")
    out = rows_of(L.dynamic_layout(cells, plan), "row_no", "value")
    # 2 rows inserted at row 3 (copies of it), then 1 row at row 7 (copy of the old row 5, now 7)
    assert out == [(1, "hdr"), (3, "销售费用"), (4, "销售费用"), (5, "销售费用"), (7, "管理费用"), (8, "管理费用"),
                   (12, "end")]
