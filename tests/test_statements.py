from decimal import Decimal

from tallyspark.operators import statements as ST
from conftest import rows_of

SCHEMA = "file_name string, sheet string, row_no int, cells array<string>"


def _bs(spark, lines):
    rows = [("f", "资产负债表", 4, ["资产", "期末", "期初", "负债", "期末", "期初"])]
    rows += [("f", "资产负债表", 4 + i, c) for i, c in enumerate(lines, start=1)]
    return spark.createDataFrame(rows, SCHEMA)


LINES = [
    ["货币资金", "1", "2", "短期借款", "3", "4"],
    ["流动资产合计", "1", "2", "流动负债合计", "3", "4"],
    ["固定资产", "5", None, "非流动负债:", None, None],
    ["非流动资产合计", "5", None, "长期借款", "6", "7"],
    [None, None, None, "负债合计", "9", "9"],             # dropped with its right panel
    ["其他", "0", "0", "非流动负债合计", "6", "7"],
    ["制表人: x", None, None, "所有者权益（或股东权益）:", None, None],  # dropped (preparer line)
    ["y", None, None, "所有者权益（或股东权益）:", None, None],
    ["z", None, None, "实收资本", "8", "8"],
    ["w", None, None, "所有者权益（或股东权益）合计", "8", "8"],
]


def test_section_cuts(spark):
    lines = ST.section_lines(ST.stack_panels(ST.read_balance_panels(_bs(spark, LINES))))
    got = rows_of(lines, "panel", "item", "category")
    assert ("assets", "货币资金", "流动资产") in got
    assert ("assets", "固定资产", "非流动资产") in got
    assert ("liab", "短期借款", "流动负债") in got
    assert ("liab", "非流动负债:", "非流动负债") in got and ("liab", "长期借款", "非流动负债") in got
    assert ("liab", "所有者权益（或股东权益）:", "所有者权益") in got and ("liab", "实收资本", "所有者权益") in got
    totals = [g for g in got if g[2] == "合计"]
    assert {t[1] for t in totals} == {"流动资产合计", "流动负债合计", "非流动资产合计", "非流动负债合计",
                                      "所有者权益（或股东权益）合计"}
    assert not any(g[1] == "负债合计" for g in got)
    # totals rows are not part of a section
    assert not any(g[1] == "流动资产合计" and g[2] != "合计" for g in got)


def test_missing_marker_is_reported(spark):
    # '非流动资产合计' also contains '流动资产合计', so only its own removal is missing
    bad = [l for l in LINES if l[0] != "非流动资产合计"]
    stacked = ST.stack_panels(ST.read_balance_panels(_bs(spark, bad)))
    miss = ST.missing_markers(stacked).collect()
    assert miss and miss[0].missing == ["m_nca"]


def test_income_keys_use_range_position(spark):
    rows = [("f", "利润表", 4, ["项目名称", "本期金额", "本年金额", "上年金额", "上年同期金额"]),
            ("f", "利润表", 5, ["收入", "1", "2", None, None]),
            ("f", "利润表", 6, [None, "1", "1", "1", "1"]),
            ("f", "利润表", 7, [" 收入 ", "3", None, None, None])]
    long = ST.melt_income(ST.read_income(spark.createDataFrame(rows, SCHEMA)))
    keys = sorted({r.line_key for r in long.collect()})
    assert keys == ["0_收入", "2_收入"]
    assert long.count() == 8   # melt keeps null amounts


def test_statement_cells(spark):
    from tallyspark.operators import rules as RU
    from tallyspark.schemas import RULES_SCHEMA
    rows = _bs(spark, LINES)
    rules = spark.createDataFrame([("原报表", "N8", "货币资金_流动资产|短期借款_流动负债", "+|-", "期末余额|期初余额"),
                                   ("原报表", "N9", "nope", "+", "期末余额")], RULES_SCHEMA)
    cells = ST.statement_cells(ST.long_statements(rows), RU.clean_rules(rules))
    got = dict(rows_of(cells, "cell", "amount"))
    assert got == {"N8": Decimal("-3.00"), "N9": Decimal("0.00")}
