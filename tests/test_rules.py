from tallyspark.operators import rules as RU
from tallyspark.schemas import RULES_SCHEMA
from conftest import rows_of


def _rules(spark, rows):
    return spark.createDataFrame(rows, RULES_SCHEMA)


def test_explode_pipe_rules_splits_in_step_and_trims(spark):
    r = _rules(spark, [("1", "E5", " 1001 | 1002 ", "+|-", "a | b"),
                       ("1", "E6", "2001", "_", " c ")])
    out = rows_of(RU.clean_rules(r), "cell", "acct_code", "item", "sign", "part_no")
    assert out == [("E5", "1001", "a", 1, 0), ("E5", "1002", "b", -1, 1), ("E6", "2001", "c", -1, 0)]


def test_operator_signs_null_blank_unknown(spark):
    r = _rules(spark, [("1", "E1", "1", None, "x"), ("1", "E2", "1", "", "x"),
                       ("1", "E3", "1", " +", "x"), ("1", "E4", "1", "*", "x"),
                       ("1", "E5", "1|2", "+||-", "x|y|z")])
    got = {(c, p): s for c, p, s in rows_of(RU.clean_rules(r), "cell", "part_no", "sign")}
    assert got[("E1", 0)] == 0 and got[("E2", 0)] == 0
    assert got[("E3", 0)] is None and got[("E4", 0)] is None


def test_unequal_lists_are_rejected_not_padded(spark):
    r = _rules(spark, [("1", "E1", "1|2", "+|-|+", "x|y"), ("1", "E2", "1|2", "+|-", "x|y")])
    assert rows_of(RU.clean_rules(r), "cell") == [("E2",), ("E2",)]
    assert rows_of(RU.rule_rejects(r), "cell") == [("E1",)]


def test_newlines_removed_only_in_split_rows(spark):
    r = _rules(spark, [("1", "E1", "1\n|2", "+|+", "x|y"), ("1", "E2", "3\n", "+", "z")])
    codes = rows_of(RU.explode_pipe_rules(r), "cell", "acct_code")
    # the plain row keeps its newline until the final trim
    assert ("E1", "1") in codes and ("E1", "2") in codes and ("E2", "3") in codes


def test_drop_opening_rules(spark):
    r = _rules(spark, [("1", "E1", "1", "+", "期初余额_金额"), ("1", "E2", None, "+", "x"),
                       ("原报表", "E3", None, "+", None), ("1", "E4", "1", "+", None),
                       ("1", "E5", "1", "+", "期末余额_金额")])
    out = rows_of(RU.drop_opening_rules(RU.clean_rules(r)), "sheet", "cell")
    assert out == [("1", "E5"), ("原报表", "E3")]


def test_read_rules_by_header_text(spark):
    rows = spark.createDataFrame(
        [("m", "1", 1, ["title"]), ("m", "1", 2, ["金额列", "单元格", "运算符", "账户代码"]),
         ("m", "1", 3, ["x", "E5", "+", "1001"])],
        "file_name string, sheet string, row_no int, cells array<string>")
    out = RU.read_rules(rows).collect()[0]
    assert (out.cell, out.accts, out.ops, out.items) == ("E5", "1001", "+", "x")

