"""Column glossary, fixed labels and explicit schemas.

Columns are English internally; *values* that predicates compare against
(markers, classes, sheet names, source headers) keep the source wording.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(10, 4)

# ---------------------------------------------------------------------------
# Fixed values that must equal the source workbooks' wording.
# ---------------------------------------------------------------------------

# Layout A balance export: the 14 positional columns, as (column, source header).
LAYOUT_A_COLUMNS = [
    ("acct_code", "账户代码"),
    ("acct_name", "账户名称"),
    ("open_dir", "期初余额_方向"),
    ("opening", "期初余额_金额"),
    ("open_debit", "期初余额_借方金额"),
    ("open_credit", "期初余额_贷方金额"),
    ("period_debit", "期间发生额_借方金额"),
    ("period_credit", "期间发生额_贷方金额"),
    ("ytd_debit", "累计发生额_借方金额"),
    ("ytd_credit", "累计发生额_贷方金额"),
    ("close_dir", "期末余额_方向"),
    ("closing", "期末余额_金额"),
    ("close_debit", "期末余额_借方金额"),
    ("close_credit", "期末余额_贷方金额"),
]
LAYOUT_A_BANNER_ROWS = 4
# Amount columns unpivoted for layout A, in source order.
LAYOUT_A_AMOUNTS = [c for c, h in LAYOUT_A_COLUMNS if "金额" in h]

# Layout B balance export (header in row 1), as (column, source header).
LAYOUT_B_COLUMNS = [
    ("acct_code", "科目代码"),
    ("acct_name", "科目名称"),
    ("currency", "货币代码"),
    ("fc_opening", "外币期初"),
    ("fc_debit", "外币借方"),
    ("fc_credit", "外币贷方"),
    ("fc_closing", "外币期末"),
    ("local_currency", "本位货币代码"),
    ("lc_opening", "本位币货币期初"),
    ("lc_debit", "本位货币借方"),
    ("lc_credit", "本位货币贷方"),
    ("lc_closing", "本位货币期末"),
]
# Unpivot order for layout B (local currency first, then foreign).
LAYOUT_B_AMOUNTS = ["lc_opening", "lc_debit", "lc_credit", "lc_closing",
                    "fc_opening", "fc_debit", "fc_credit", "fc_closing"]

HEADER_OF = dict(LAYOUT_A_COLUMNS + LAYOUT_B_COLUMNS)

# Rule-table headers (header in row 2 of each rule sheet).

SHEET_STATEMENT = "原报表"
SHEET_EXPENSE = "8_费用"
OPENING_MARKER = "期初余额"
CLOSING_ITEM = "期末余额_金额"

# Account class by first digit of the code.
ACCOUNT_CLASSES = [("1", "资产"), ("2", "负债"), ("4", "权益"), ("5", "成本"), ("6", "损益")]

# FX: sheets translated at the closing rate, and at the average rate.
CLOSING_RATE_SHEETS = ["1", "2", "4", "4.1_递延", "5", "6"]
AVERAGE_RATE_SHEETS = ["8"]

# Expense ledger.
EXPENSE_AREAS = ["销售费用", "管理费用", "研发费用"]  # selling, admin, R&D
EXPENSE_FIXED_STARTS = {"销售费用": 2, "管理费用": 168, "研发费用": 348}
FX_YES = "是"

# Statement markers (two-panel balance sheet).
MARK_CUR_ASSETS_TOTAL = "流动资产合计"
MARK_NONCUR_ASSETS_TOTAL = "非流动资产合计"
MARK_CUR_LIAB_TOTAL = "流动负债合计"
MARK_NONCUR_LIAB_START = "非流动负债:"
MARK_NONCUR_LIAB_TOTAL = "非流动负债合计"
MARK_EQUITY_START = "所有者权益（或股东权益）"
MARK_EQUITY_TOTAL = "所有者权益（或股东权益）合计"
MARK_TOTAL = "合计"
MARK_PREPARER = "制表人"
SECTION_CUR_ASSETS = "流动资产"
SECTION_NONCUR_ASSETS = "非流动资产"
SECTION_CUR_LIAB = "流动负债"
SECTION_NONCUR_LIAB = "非流动负债"
SECTION_EQUITY = "所有者权益"
SECTION_TOTAL = "合计"
SECTION_INCOME = "损益"
STATEMENT_BALANCE = "资产负债表"
STATEMENT_INCOME = "利润表"
BALANCE_AMOUNT_TYPES = [("close", "期末余额"), ("open", "期初余额")]
INCOME_AMOUNT_TYPES = [("cur", "本期金额"), ("ytd", "本年金额"), ("prior", "上年金额"),
                       ("prior_ytd", "上年同期金额")]

# Counterparty sheets and helper-row labels.
COUNTERPARTY_SHEETS = ["CF2", "应收账款", "应付账款", "预收账款", "预付账款", "其他非流动资产"]
CF2_HELPER_VALUES = ["款项性质", "合计", "勾稽核对"]
FILL_LABELS = ["下方填写合并关联方", "下方填写非合并关联方", "下方填写其他"]
CURRENCY_LABEL = "币种"

# File-name fragments.
SKIP_NAME_FRAGMENTS = ["~$"]
SKIP_NAME_FRAGMENTS_EXTRACT = ["合并", "日志", "~$"]
SKIP_NAME_FRAGMENT_RECURSIVE = "试算"
COMPANY_NAME_FRAGMENT = "公司"
SMALL_MERGE_FRAGMENT = "小合并"
LOG_FRAGMENT = "日志"

# ---------------------------------------------------------------------------
# Explicit schemas.
# ---------------------------------------------------------------------------

ROWS_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("row_no", T.IntegerType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
])

RULES_SCHEMA = T.StructType([
    T.StructField("sheet", T.StringType()),
    T.StructField("cell", T.StringType()),
    T.StructField("accts", T.StringType()),
    T.StructField("ops", T.StringType()),
    T.StructField("items", T.StringType()),
])

# ---------------------------------------------------------------------------
# Counterparty output headers, in source order (each output
# starts with the file-name column).
# ---------------------------------------------------------------------------

OTHER_RECEIVABLES_HEADERS = [
    "文件名", "名称", "款项性质", "期初余额", "借方发生额", "贷方发生额", "期末余额", "单项坏账",
    "收到往来款", "支付往来款", "1年以内", "1-2年", "2-3年", "3-4年", "4-5年", "5年以上",
    "外币金额", "币种", "账龄核对", "外币核对"]
OTHER_PAYABLES_HEADERS = [
    "文件名", "名称", "款项性质", "期初余额", "借方发生额", "贷方发生额", "期末余额",
    "收到往来款", "支付往来款", "1年以内", "1-2年", "2-3年", "3年以上", "外币金额", "币种",
    "账龄核对", "外币核对"]
PAYABLES_HEADERS = [
    "文件名", "供应商编码", "供应商名称", "合并关联方（是/不填）", "非合并关联方（是/不填）", "款项性质",
    "期末余额_原币", "币种", "人民币金额", "1年以内", "1-2年", "2-3年", "3年以上", "余额合计核对",
    "外币金额核对", "余额由外币和人民币组成对，其中人民币金额"]
RECEIVABLES_HEADERS = [
    "文件名", "客户编码", "客户名称", "合并关联方（是/不填）", "非合并关联方（是/不填）", "期初余额_原币",
    "币种", "人民币金额", "1年以内", "1-2年", "2-3年", "3-4年", "4-5年", "5年以上",
    "是否单项认定计提坏账准备", "余额合计核对", "外币金额核对", "余额由外币和人民币组成对，其中人民币金额"]
ADVANCES_HEADERS = [
    "文件名", "客户编码", "客户名称", "合并关联方（是/不填）", "非合并关联方（是/不填）", "期初余额_原币",
    "币种", "人民币金额", "1年以内", "1-2年", "2-3年", "3年以上", "余额合计核对", "外币金额核对",
    "余额由外币和人民币组成对，其中人民币金额", "税率", "合同负债", "其他流动负债"]
SUPPLIER_CODE_LABEL = "供应商编码"
CUSTOMER_CODE_LABEL = "客户编码"

# Titles written to A1 of each output sheet of the expense
# working paper (audited tables, then year-on-year tables).
EXPENSE_SHEET_TITLES = {
    "审定表_销售费用": "销售费用审定表",
    "审定表_管理费用": "管理费用审定表",
    "审定表_研发费用": "研发费用审定表",
    "同期比较_销售费用": "销售费用本期与上年同期比较表",
    "同期比较_管理费用": "管理费用本期与上年同期比较表",
    "同期比较_研发费用": "研发费用本期与上年同期比较表",
}

# Read ranges of the expense papers: (table, first cell, last cell), and their columns.
AUDIT_RANGES = [("审定表_销售费用", "B1", "G61"), ("审定表_管理费用", "B67", "G131"), ("审定表_研发费用", "B137", "G201")]
YOY_RANGES = [("同期比较_销售费用", "A93", "C123"), ("同期比较_管理费用", "A126", "C156"),
              ("同期比较_研发费用", "A159", "C189")]
EXP_NAMES = ["科目编码", "底稿科目", "附注分类", "本期未审", "重分类调整", "审计调整"]
YOY_NAMES = ["项目", "本期发生额", "上期发生额"]
