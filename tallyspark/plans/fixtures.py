"""Input tables of the audit domain, derived from the provided star schema
with the DataFrame API (see FIXTURES.md). Everything here grows with the
source tables; literal rows only add edge cases on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.schemas import MONEY, RATE, RULES_SCHEMA
from tallyspark.sources.tables import table

CUTOFF = "1998-01-01 00:00:00"

# Fixed test values: rate per sheet (closing 7.1884, average 7.1140).
RATE_ROWS = [("1", "7.1884"), ("2", "7.1884"), ("4", "7.1884"), ("4.1_递延", "7.1884"),
             ("5", "7.1884"), ("6", "7.1884"), ("8", "7.1140")]

# Fixed edge-case rule rows added to the derived ones.
EDGE_RULES = [
    ("1", "E90", "100101|100102", "+|x", "期末余额_金额|期末余额_金额"),   # unknown operator part
    ("1", "E91", "100101", None, "期末余额_金额"),                          # blank operator -> 0
    ("1", "E91", "100102", "+", "期末余额_金额"),                           # second rule, same cell
    ("1", "E92", None, "+", "期末余额_金额"),                               # null code
    ("1", "E93", "100101", "+", "期初余额_金额"),                           # opening rule
    ("1", "E94", "100101|100102", "+|-|+", "期末余额_金额|期末余额_金额"),  # unequal lists
    ("1", "E95", "100201", " +", "期末余额_金额"),                          # ' +' is unknown
    ("2", "E96", " 200101 | 200102", "+|-", "期末余额_金额 | 期末余额_金额"),  # trimmed parts
    ("原报表", "E97", "600101", "+", None),                                 # null item kept on 原报表
]


def _ts(df: DataFrame, c: str):
    return F.lit(CUTOFF).cast(df.schema[c].dataType)


def tb(spark: SparkSession, d: str) -> DataFrame:
    """``tb(company, acct_code, acct_name, currency, opening, debit, credit, closing)``."""
    l = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice",
                                           "l_shipdate", "l_returnflag", "l_linestatus")
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    cls = (F.when(F.col("p_type") == "ECONOMY", "1").when(F.col("p_type") == "STANDARD", "2")
           .when(F.col("p_type") == "SMALL", "4").when(F.col("p_type") == "MEDIUM", "5")
           .otherwise("6"))
    base = (l.join(p, l.l_partkey == p.p_partkey)
            .join(s, l.l_suppkey == s.s_suppkey)
            .join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("n_name").alias("company"), cls.alias("cls"),
                    (1 + F.col("p_size") % 5).cast("string").alias("l1"),
                    (1 + F.col("p_partkey") % 4).cast("string").alias("l2"),
                    F.when(F.col("l_linestatus") == "O", "CNY").otherwise("USD").alias("currency"),
                    F.col("l_extendedprice").cast(MONEY).alias("amt"),
                    F.col("l_shipdate").alias("d"), F.col("l_returnflag").alias("rf")))
    before = F.col("d") < _ts(l, "l_shipdate")
    after = F.col("d") >= _ts(l, "l_shipdate")
    zero = F.lit(0).cast(MONEY)
    return (base.groupBy("company",
                         F.concat("cls", F.lit("00"), "l1", F.lit("0"), "l2").alias("acct_code"),
                         F.concat(F.lit("A"), "cls", F.lit("00"), "l1", F.lit("-S"), "l2").alias("acct_name"),
                         "currency")
            .agg(F.sum(F.when(before, F.col("amt")).otherwise(zero)).cast(MONEY).alias("opening"),
                 F.sum(F.when(after & (F.col("rf") != "R"), F.col("amt")).otherwise(zero)).cast(MONEY).alias("debit"),
                 F.sum(F.when(after & (F.col("rf") == "R"), F.col("amt")).otherwise(zero)).cast(MONEY).alias("credit"),
                 F.sum(F.when(before, F.col("amt")).when(F.col("rf") == "R", -F.col("amt"))
                       .otherwise(F.col("amt"))).cast(MONEY).alias("closing")))


def _dir(c):
    return F.when(F.col(c) > 0, "借").when(F.col(c) < 0, "贷").otherwise("平")


def bal_a(spark: SparkSession, d: str) -> DataFrame:
    """Layout-A balances per company: detail codes plus level-1 (4-char)
    totals, as a tree-expanded export has them."""
    t = tb(spark, d).withColumn("l1", F.substring("acct_code", 1, 4)) \
        .withColumn("l1_name", F.split_part("acct_name", F.lit("-"), F.lit(1)))
    sums = [F.sum(c).alias(c) for c in ("opening", "debit", "credit", "closing")]
    # detail rows and level-1 totals from one aggregation (grouping sets)
    g = t.groupingSets([["company", "acct_code", "acct_name"], ["company", "l1", "l1_name"]],
                       "company", "acct_code", "acct_name", "l1", "l1_name").agg(*sums)
    u = g.select("company", F.coalesce("acct_code", "l1").alias("acct_code"),
                 F.coalesce("acct_name", "l1_name").alias("acct_name"),
                 "opening", "debit", "credit", "closing")
    m = lambda e: e.cast(MONEY)
    return u.select(
        "company", "acct_code", "acct_name",
        _dir("opening").alias("open_dir"),
        m(F.col("opening")).alias("opening"),
        m(F.when(F.col("opening") > 0, F.col("opening"))).alias("open_debit"),
        m(F.when(F.col("opening") < 0, -F.col("opening"))).alias("open_credit"),
        m(F.col("debit")).alias("period_debit"),
        m(F.col("credit")).alias("period_credit"),
        m(F.col("debit")).alias("ytd_debit"),
        m(F.when(F.col("credit") != 0, F.col("credit"))).alias("ytd_credit"),
        _dir("closing").alias("close_dir"),
        m(F.col("closing")).alias("closing"),
        m(F.when(F.col("closing") > 0, F.col("closing"))).alias("close_debit"),
        m(F.when(F.col("closing") < 0, -F.col("closing"))).alias("close_credit"))


def bal_b(spark: SparkSession, d: str) -> DataFrame:
    """Layout-B balances per company: 6-char codes, both currencies; foreign
    amounts only on USD lines, local amounts at a fixed 7.1884."""
    t = tb(spark, d)
    rate = F.lit("7.1884").cast(RATE)
    usd = F.col("currency") == "USD"

    def lc(c):
        return F.round(F.when(usd, F.col(c) * rate).otherwise(F.col(c)), 2).cast(MONEY)

    def fc(c):
        return F.when(usd, F.col(c)).cast(MONEY)

    return t.select(
        "company", "acct_code", "acct_name", "currency",
        fc("opening").alias("fc_opening"), fc("debit").alias("fc_debit"),
        fc("credit").alias("fc_credit"), fc("closing").alias("fc_closing"),
        F.lit("CNY").alias("local_currency"),
        lc("opening").alias("lc_opening"), lc("debit").alias("lc_debit"),
        lc("credit").alias("lc_credit"), lc("closing").alias("lc_closing"))


def rules(spark: SparkSession, d: str) -> DataFrame:
    """Rule table ``(sheet, cell, accts, ops, items)``: one three-part rule per
    level-1 code (the third account never exists), expense-sheet rules for
    classes 5 and 6, plus the edge rows."""
    t = tb(spark, d)
    l1 = F.substring("acct_code", 1, 4)
    first = F.substring("acct_code", 1, 1)
    sheet = (F.when(first == "1", "1").when(first == "2", "2").when(first == "4", "4")
             .when(first == "5", "8").otherwise("原报表"))
    from pyspark.sql.window import Window
    prefixes = t.select(l1.alias("l1"), sheet.alias("sheet")).distinct()  # bounded by the code space
    w = Window.partitionBy("sheet").orderBy("l1")
    main = prefixes.select(
        "sheet",
        F.concat(F.lit("E"), (F.row_number().over(w) + 4).cast("string")).alias("cell"),
        F.concat("l1", F.lit("01|"), "l1", F.lit("02|"), "l1", F.lit("09")).alias("accts"),
        F.lit("+|-|_").alias("ops"),
        F.lit("期末余额_金额|期间发生额_贷方金额|期末余额_金额").alias("items"))
    fee_src = (t.select(l1.alias("l1")).filter(F.substring("l1", 1, 1).isin("5", "6")).distinct()
               .withColumn("c", F.substring("l1", 1, 1)))
    w2 = Window.partitionBy("c").orderBy("l1")
    fee = fee_src.select(
        F.lit("8_费用").alias("sheet"),
        F.concat(F.lit("E"), (F.when(F.col("c") == "6", 29).otherwise(140)
                              + F.row_number().over(w2)).cast("string")).alias("cell"),
        F.concat("l1", F.lit("01")).alias("accts"),
        F.lit("+").alias("ops"),
        F.lit("期间发生额_借方金额").alias("items"))
    edge = spark.createDataFrame(EDGE_RULES, RULES_SCHEMA)
    return main.unionByName(fee).unionByName(edge)


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATE_ROWS, "sheet string, rate string").select(
        "sheet", F.col("rate").cast(RATE).alias("rate"))



# ---------------------------------------------------------------------------
# Ledger, scope, expense template.
# ---------------------------------------------------------------------------

def ledger(spark: SparkSession, d: str) -> DataFrame:
    """``ledger(company, company_code, func_area, gl_text, amount_text)``;
    amounts carry thousands commas and, for returned lines, a trailing minus."""
    l = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_name")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    price = F.col("l_extendedprice")
    whole = F.floor(price).cast("int")
    int_text = F.when(price >= 1000, F.concat(F.floor(price / 1000).cast("int").cast("string"), F.lit(","),
                                              F.lpad((whole % 1000).cast("string"), 3, "0"))) \
        .otherwise(whole.cast("string"))
    cents = F.lpad(((price.cast(MONEY) * 100).cast("bigint") % 100).cast("string"), 2, "0")
    text = F.concat(int_text, F.lit("."), cents,
                    F.when(F.col("l_returnflag") == "R", "-").otherwise(""))
    area = (F.when(F.col("p_type") == "ECONOMY", "销售费用").when(F.col("p_type") == "STANDARD", "管理费用")
            .when(F.col("p_type") == "SMALL", "研发费用").otherwise("生产成本"))
    return (l.join(p, l.l_partkey == p.p_partkey)
            .join(s, l.l_suppkey == s.s_suppkey)
            .join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("n_name").alias("company"),
                    F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("company_code"),
                    area.alias("func_area"), F.col("p_name").alias("gl_text"), text.alias("amount_text")))


# Fixed extra scope rows: a code with no ledger lines, and a duplicated code
# whose later row must win.
EXTRA_SCOPE = [(99, "EXTRA", "EXTRA", "C9999", "否", 99),
               (100, "NATION_3", "NATION_3-NEW", "C0003", "否", 100)]


def scope(spark: SparkSession, d: str) -> DataFrame:
    """``scope(serial, company, report_name, sap_code, fx_flag, seq)``: one
    row per nation that has a supplier, plus the literal extra rows."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    ent = s.select("s_nationkey").distinct().join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    base = ent.select(F.col("n_nationkey").cast("bigint").alias("serial"), F.col("n_name").alias("company"),
                      F.col("n_name").alias("report_name"),  # per-company files are named by it
                      F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("sap_code"),
                      F.when(F.col("n_regionkey") == 1, "是").when(F.col("n_regionkey") == 2, F.lit(None))
                      .otherwise("否").alias("fx_flag"),
                      F.col("n_nationkey").cast("bigint").alias("seq"))
    extra = spark.createDataFrame(
        EXTRA_SCOPE, "serial bigint, company string, report_name string, sap_code string, fx_flag string, seq bigint")
    return base.unionByName(extra)


def scope_rows(spark: SparkSession, d: str) -> DataFrame:
    """The scope as sheet rows of workbooks, one for each FX flag: header in row 1, a
    row each at ``seq + 2`` of the first sheet, and a second sheet of notes."""
    from tallyspark.operators.ledger import SCOPE_HEADERS
    s = scope(spark, d).withColumn("file_name", F.concat(F.lit("scope_"), F.coalesce("fx_flag", F.lit("无"))))
    cells = F.array(*[F.col(c).cast("string") for c, _ in SCOPE_HEADERS])
    body = s.select("file_name", F.lit("Sheet1").alias("sheet"), F.lit(1).alias("sheet_idx"), (F.col("seq") + 2).cast("int").alias("row_no"), cells.alias("cells"))
    head = F.array(*[F.lit(h) for _, h in SCOPE_HEADERS])
    sheets = F.array(F.struct(F.lit("Sheet1").alias("sheet"), F.lit(1).alias("sheet_idx"), F.lit(1).alias("row_no"), head.alias("cells")),
                     F.struct(F.lit("备注").alias("sheet"), F.lit(2).alias("sheet_idx"), F.lit(1).alias("row_no"), head.alias("cells")))
    return s.select("file_name").distinct().select("file_name", F.inline(sheets)).unionByName(body)


def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    """The ledger as sheet rows, one workbook a company, its columns in another
    order than the reader's."""
    from tallyspark.sources.files import LEDGER_HEADERS
    l = ledger(spark, d)
    order = list(reversed(LEDGER_HEADERS))
    body = l.select(F.col("company").alias("file_name"), (F.pmod(F.xxhash64("gl_text", "amount_text"), F.lit(1_000_000)) + 2).cast("int").alias("row_no"),
                    F.array(*[F.col(c) for c, _ in order]).alias("cells"))
    head = l.select(F.col("company").alias("file_name")).distinct().select("file_name", F.lit(1).alias("row_no"), F.array(*[F.lit(h) for _, h in order]).alias("cells"))
    return head.unionByName(body).select("file_name", F.lit("FBL3H费用").alias("sheet"), "row_no", "cells")


def expense_template(spark: SparkSession, d: str) -> DataFrame:
    """Column A of each company's expense sheet as rows: one area label per
    customer row (so slot counts grow with the data)."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey") % 4
    label = (F.when(k == 0, "销售费用").when(k == 1, "管理费用").when(k == 2, "研发费用"))
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("n_name").alias("file_name"), F.lit("8_费用").alias("sheet"),
                    (F.col("c_custkey") + 2).cast("int").alias("row_no"),
                    F.array(label).alias("cells")))


def rules_b(spark: SparkSession, d: str) -> DataFrame:
    """The rule table with layout-B item labels."""
    r = rules(spark, d)
    items = F.col("items")
    for a, b in [("期末余额_金额", "本位货币期末"), ("期间发生额_贷方金额", "本位货币贷方"),
                 ("期间发生额_借方金额", "本位货币借方"), ("期初余额_金额", "本位币货币期初")]:
        items = F.replace(items, F.lit(a), F.lit(b))
    return r.withColumn("items", items)


# ---------------------------------------------------------------------------
# Sheet rows ``(file_name, sheet, row_no, cells)`` of balance exports.
# ---------------------------------------------------------------------------

def _code_row(code):
    cls = F.substring(code, 1, 1)
    idx = (F.when(cls == "1", 0).when(cls == "2", 1).when(cls == "4", 2).when(cls == "5", 3).otherwise(4))
    l1 = F.substring(code, 4, 1).cast("int")
    l2 = F.when(F.length(code) == 6, F.substring(code, 6, 1).cast("int")).otherwise(0)
    return (idx * 5 + l1 - 1) * 5 + l2


def rows_a(spark: SparkSession, d: str) -> DataFrame:
    """Layout-A exports as sheet rows: 4 banner rows, one row per account
    (row number from the code, no window), a trailer row; plus one file
    with two non-empty sheets."""
    a = bal_a(spark, d)
    from tallyspark.schemas import LAYOUT_A_COLUMNS
    body = a.select(F.col("company").alias("file_name"), F.lit("Sheet1").alias("sheet"),
                    (F.lit(5) + _code_row(F.col("acct_code"))).cast("int").alias("row_no"),
                    F.array(*[F.col(c).cast("string") for c, _ in LAYOUT_A_COLUMNS]).alias("cells"))
    comp = a.select(F.col("company").alias("file_name")).distinct()
    banner = comp.select("file_name", F.lit("Sheet1").alias("sheet"),
                         F.inline(F.array(
                             F.struct(F.lit(1).alias("row_no"), F.array(F.lit("科目余额表")).alias("cells")),
                             F.struct(F.lit(2).alias("row_no"), F.array(F.col("file_name")).alias("cells")),
                             F.struct(F.lit(3).alias("row_no"),
                                      F.array(F.lit("科目"), F.lit(None), F.lit("期初余额")).alias("cells")),
                             F.struct(F.lit(4).alias("row_no"),
                                      F.array(*[F.lit(h) for _, h in LAYOUT_A_COLUMNS]).alias("cells")),
                             F.struct(F.lit(300).alias("row_no"),
                                      F.array(F.lit("合计"), F.lit(None)).alias("cells")))))
    multi = spark.createDataFrame(
        [("MULTI", "Sheet1", 1, ["x"]), ("MULTI", "Sheet1", 5, ["1001", "y"]), ("MULTI", "Sheet2", 1, ["z"])],
        "file_name string, sheet string, row_no int, cells array<string>")
    return body.unionByName(banner.select("file_name", "sheet", F.col("row_no").cast("int"), "cells")) \
        .unionByName(multi)


def rows_b(spark: SparkSession, d: str) -> DataFrame:
    """Layout-B exports as sheet rows: header in row 1 (columns in a
    different order than the canonical one), detail rows, a total row
    without code."""
    from tallyspark.schemas import LAYOUT_B_COLUMNS
    order = [c for c, _ in LAYOUT_B_COLUMNS]
    order = order[2:] + order[:2]  # codes and names last: located by header
    hdr = dict(LAYOUT_B_COLUMNS)
    b = bal_b(spark, d)
    body = b.select(F.col("company").alias("file_name"), F.lit("Sheet1").alias("sheet"),
                    (F.lit(2) + _code_row(F.col("acct_code")) * 2
                     + F.when(F.col("currency") == "USD", 1).otherwise(0)).cast("int").alias("row_no"),
                    F.array(*[F.col(c).cast("string") for c in order]).alias("cells"))
    comp = b.select(F.col("company").alias("file_name")).distinct()
    extra = comp.select("file_name", F.lit("Sheet1").alias("sheet"),
                        F.inline(F.array(
                            F.struct(F.lit(1).alias("row_no"),
                                     F.array(*[F.lit(hdr[c]) for c in order]).alias("cells")),
                            F.struct(F.lit(999).alias("row_no"),
                                     F.array(*([F.lit(None).cast("string")] * 10 + [F.lit(None), F.lit("合计")])).alias("cells")))))
    return body.unionByName(extra.select("file_name", "sheet", F.col("row_no").cast("int"), "cells"))


# ---------------------------------------------------------------------------
# Counterparty sheets of working papers, as sheet rows.
# ---------------------------------------------------------------------------

def _cp_base(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus",
                                         "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    k = F.col("o_orderkey")
    code = (F.when(k % 97 == 0, "合计").when(k % 89 == 0, F.lit(None)).when(k % 61 == 0, "下方填写其他")
            .otherwise(F.concat(F.lit("K"), F.col("c_custkey").cast("string"))))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("c_nationkey").cast("string").alias("file_name"),
                    (k + 10).cast("int").alias("row_no"),
                    F.when(k % 59 == 0, "供应商编码").otherwise(code).alias("code_ap"),
                    F.when(k % 59 == 0, "客户编码").otherwise(code).alias("code_ar"),
                    F.col("c_name").alias("name"),
                    F.when(k % 101 == 0, "款项性质").when(k % 103 == 0, "勾稽核对")
                    .when(k % 89 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("nature"),
                    F.when(k % 83 == 0, "币种").when(k % 5 == 0, "USD").when(k % 7 == 0, F.lit(None))
                    .otherwise("CNY").alias("cur"),
                    F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "0")
                    .otherwise(F.col("o_totalprice").cast(MONEY).cast("string")).alias("amt"),
                    F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("c_acctbal").cast(MONEY).cast("string")).alias("a1"),
                    F.when(k % 19 == 0, F.lit(None)).otherwise(F.col("c_custkey").cast("string")).alias("a2"),
                    F.when(k % 23 == 0, F.lit(None)).when(k % 29 == 0, "n/a")
                    .otherwise(F.col("o_orderstatus")).alias("a3"),
                    F.when(k % 3 == 0, "是").alias("flag")))


def _placed_array(width: int, placement: dict):
    none = F.lit(None).cast("string")
    return F.array(*[placement.get(i, none) for i in range(width)])


CP_LAYOUTS = {
    "CF2": (46, {11: "name", 12: "nature", 13: "a1", 14: "a2", 15: "a3", 16: "amt", 27: "cur",
                 30: "name", 31: "nature", 32: "a1", 33: "a2", 34: "a3", 35: "amt", 43: "cur"}),
    "应付账款": (16, {0: "code_ap", 1: "name", 2: "flag", 4: "nature", 5: "a1", 6: "cur", 7: "amt", 8: "amt"}),
    "预付账款": (16, {0: "code_ap", 1: "name", 2: "flag", 4: "nature", 5: "a1", 6: "cur", 7: "amt", 8: "amt"}),
    "其他非流动资产": (16, {0: "code_ap", 1: "name", 2: "flag", 4: "nature", 5: "a1", 6: "cur", 7: "amt",
                         8: "amt"}),
    "应收账款": (18, {0: "code_ar", 1: "name", 2: "flag", 4: "a1", 5: "cur", 6: "amt", 7: "amt", 16: "a3"}),
    "预收账款": (18, {0: "code_ar", 1: "name", 2: "flag", 4: "a1", 5: "cur", 6: "amt", 7: "amt", 16: "a3"}),
}


CP_SKIP = {"CF2": 3, "应付账款": 4, "预付账款": 4, "其他非流动资产": 4, "应收账款": 3, "预收账款": 3}


_CP_BANNER = {0: "K0", 1: "banner", 5: "CNY", 6: "100.00", 7: "100.00", 11: "banner", 12: "其他", 13: "1", 16: "5",
              30: "banner", 31: "其他", 32: "1", 35: "5"}


def _cp_cells(sheet: str):
    width, place = CP_LAYOUTS[sheet]
    return _placed_array(width, {i: F.col(c) for i, c in place.items()} | ({width - 1: F.lit("x")} if width != 46 else {}))


def _cp_banner(sheet: str):
    width = CP_LAYOUTS[sheet][0]
    return _placed_array(width, {i: F.lit(v) for i, v in _CP_BANNER.items() if i < width})


def counterparty_rows(spark: SparkSession, d: str) -> DataFrame:
    """Six counterparty sheets per paper (one paper per nation), with banner
    rows on top that would pass every filter if they were not skipped."""
    base = _cp_base(spark, d)
    parts = []
    for sheet in CP_LAYOUTS:
        parts.append(base.select("file_name", F.lit(sheet).alias("sheet"), "row_no", _cp_cells(sheet).alias("cells")))
        files = base.select("file_name").distinct()
        parts.append(files.select("file_name", F.lit(sheet).alias("sheet"),
                                  F.explode(F.array(*[F.lit(i) for i in range(1, CP_SKIP[sheet] + 1)]))
                                  .alias("row_no"),
                                  _cp_banner(sheet).alias("cells")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counterparty_papers(spark: SparkSession, d: str) -> DataFrame:
    """The rows of :func:`counterparty_rows` where all six sheets are wanted: orders and
    customers are joined once for them, not once a sheet."""
    base = _cp_base(spark, d)

    def all_sheets(df, rows):
        return df.select("file_name", F.inline(F.array(*[F.struct(F.lit(sheet).alias("sheet"), row_no.alias("row_no"), cells.alias("cells"))
                                                         for sheet, row_no, cells in rows])))

    banner = [(sheet, F.lit(i), _cp_banner(sheet)) for sheet in CP_LAYOUTS for i in range(1, CP_SKIP[sheet] + 1)]
    return all_sheets(base, [(sheet, F.col("row_no"), _cp_cells(sheet)) for sheet in CP_LAYOUTS]).unionByName(
        all_sheets(base.select("file_name").distinct(), banner))


# ---------------------------------------------------------------------------
# Financial statements per supplier (one statement file per supplier), amounts
# from the supplier's lineitem totals; line wording is a fixed template.
# ---------------------------------------------------------------------------

# Fixed test values: balance-sheet lines (range row, asset, asset coefficients
# on (sales, returns, quantity), liability/equity line, its coefficients).
BALANCE_TEMPLATE = [
    (1, "流动资产:", None, "流动负债:", None),
    (2, "货币资金", (1, 0, 0), "短期借款", (0, 1, 0)),
    (3, "应收账款", (0, 1, 0), "应付账款", (0, 0, 1)),
    (4, "存货", (0, 0, 1), "应付职工薪酬", None),
    (5, "流动资产合计", (1, 1, 1), "流动负债合计", (0, 1, 1)),
    (6, "非流动资产:", None, "非流动负债:", None),
    (7, " 固定资产 ", (0.5, 0, 0), "长期借款", (0.25, 0, 0)),
    (8, "无形资产", None, "递延收益", (0, 0.5, 0)),
    (9, "非流动资产合计", (0.5, 0, 0), "非流动负债合计", (0.25, 0.5, 0)),
    (10, None, None, "负债合计", (0.25, 1.5, 1)),
    (11, "资产总计", (1.5, 1, 1), "所有者权益（或股东权益）:", None),
    (12, "其他", (0, 0, 0), "实收资本", (0, 0, 2)),
    (13, "长期待摊费用合计", (0, 0.1, 0), "资本公积", (0.1, 0, 0)),
    (14, "", None, "未分配利润", (0, 0.3, 0)),
    (15, "x", None, "所有者权益（或股东权益）合计", (0.1, 0.3, 2)),
    (16, "制表人: 张三", None, None, None),
]
# Income lines: (range row, item, coefficients on (sales, returns, quantity)).
INCOME_TEMPLATE = [
    (1, "一、营业收入", (1, 0, 0)),
    (2, "减：营业成本", (0, 1, 0)),
    (3, "税金及附加", None),
    (4, "销售费用", (0, 0, 1)),
    (5, None, (1, 1, 1)),
    (6, "销售费用", (0.5, 0, 0)),
    (7, " 二、营业利润 ", (1, -1, -1)),
    (8, "制表人：", None),
]
# Statement-sheet rules over line keys and amount types.
STATEMENT_RULES = [
    ("原报表", "N8", "货币资金_流动资产", "+", "期末余额"),
    ("原报表", "N9", "应收账款_流动资产|存货_流动资产", "+|+", "期末余额|期末余额"),
    ("原报表", "N10", "固定资产_非流动资产", "+", "期初余额"),
    ("原报表", "N11", "短期借款_流动负债|流动负债合计_合计", "-|+", "期末余额|期末余额"),
    ("原报表", "N12", "长期借款_非流动负债", "+", "期末余额"),
    ("原报表", "N13", "实收资本_所有者权益", "+", "期末余额"),
    ("原报表", "N14", "0_一、营业收入", "+", "本期金额"),
    ("原报表", "N15", "5_销售费用|3_销售费用", "+|+", "本年金额|本年金额"),
    ("原报表", "N16", "不存在_流动资产", "+", "期末余额"),
]


def supplier_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per supplier: sales, returns and quantity as exact decimals."""
    l = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    amt = F.col("l_extendedprice").cast(MONEY)
    t = l.groupBy("l_suppkey").agg(
        F.sum(amt).cast(MONEY).alias("sales"),
        F.sum(F.when(F.col("l_returnflag") == "R", amt).otherwise(F.lit(0).cast(MONEY))).cast(MONEY).alias("ret"),
        F.sum(F.col("l_quantity").cast(MONEY)).cast(MONEY).alias("qty"))
    return t.join(s, t.l_suppkey == s.s_suppkey).select(F.col("s_name").alias("file_name"), "sales", "ret", "qty")


def _amount(coef, scale="1"):
    if coef is None:
        return F.lit(None).cast("string")
    e = (F.col("sales") * F.lit(str(coef[0])).cast("decimal(10,4)")
         + F.col("ret") * F.lit(str(coef[1])).cast("decimal(10,4)")
         + F.col("qty") * F.lit(str(coef[2])).cast("decimal(10,4)"))
    e = F.round(F.round(e, 2) * F.lit(scale).cast("decimal(10,4)"), 2).cast(MONEY)
    return e.cast("string")


def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sheet rows of each supplier's statement file: balance sheet A4:F68 and
    income statement A4:E79 (header rows included)."""
    t = supplier_totals(spark, d)
    lit = lambda v: F.lit(v).cast("string")
    bal = [F.struct(F.lit(4).alias("row_no"),
                    F.array(*[lit(h) for h in ["资产", "期末余额", "上年年末余额", "负债和所有者权益", "期末余额",
                                                "上年年末余额"]]).alias("cells"))]
    for r, asset, ac, liab, lc in BALANCE_TEMPLATE:
        bal.append(F.struct(F.lit(4 + r).alias("row_no"),
                            F.array(lit(asset), _amount(ac), _amount(ac, "0.9"),
                                    lit(liab), _amount(lc), _amount(lc, "0.9")).alias("cells")))
    inc = [F.struct(F.lit(4).alias("row_no"),
                    F.array(*[lit(h) for h in ["项目名称", "本期金额", "本年金额", "上年金额", "上年同期金额"]]).alias("cells"))]
    for r, item, c in INCOME_TEMPLATE:
        inc.append(F.struct(F.lit(4 + r).alias("row_no"),
                            F.array(lit(item), _amount(c), _amount(c, "1.1"), _amount(c, "0.8"),
                                    _amount(c, "0.7")).alias("cells")))
    b = t.select("file_name", F.lit("资产负债表").alias("sheet"), F.inline(F.array(*bal)))
    i = t.select("file_name", F.lit("利润表").alias("sheet"), F.inline(F.array(*inc)))
    return b.unionByName(i)


def statement_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATEMENT_RULES, RULES_SCHEMA)


def group_statements(spark: SparkSession, d: str):
    """Group statement workbook: balance sheet with two panels (names with a
    '.1' suffix on the right) and income statement, one block per company."""
    t = supplier_totals(spark, d)
    rows = []
    for r, asset, ac, liab, lc in BALANCE_TEMPLATE:
        rows.append(F.struct(F.lit(asset).cast("string").alias("项目"), F.lit(r).alias("行次"),
                             _amount(ac).alias("期末余额"), _amount(ac, "0.9").alias("年初余额"),
                             F.lit(liab).cast("string").alias("项目.1"), F.lit(r).alias("行次.1"),
                             _amount(lc).alias("期末余额.1"), _amount(lc, "0.9").alias("年初余额.1")))
    bal = t.select(F.col("file_name").alias("公司名称"), F.inline(F.array(*rows)))
    irows = []
    for r, item, c in INCOME_TEMPLATE:
        irows.append(F.struct(F.lit(item).cast("string").alias("项目"), F.lit(r).alias("行次"),
                              _amount(c).alias("本期发生额"), _amount(c, "1.1").alias("本年累计发生额"),
                              _amount(c, "0.8").alias("上年同期累计发生额")))
    inc = t.select(F.col("file_name").alias("公司名称"), F.inline(F.array(*irows)))
    return bal, inc


def group_balances_text(spark: SparkSession, d: str) -> DataFrame:
    """Group balance export: company + layout B, amounts as text with
    thousands commas and a trailing minus for negatives."""
    from tallyspark.schemas import LAYOUT_B_COLUMNS
    b = bal_b(spark, d)

    def text(c):
        v = F.col(c)
        return F.when(v.isNull(), F.lit(None)).otherwise(
            F.concat(F.format_number(F.abs(v), 2), F.when(v < 0, "-").otherwise("")))

    out = [F.col("company").alias("公司名称")]
    for c, h in LAYOUT_B_COLUMNS:
        out.append((text(c) if c.startswith(("fc_", "lc_")) else F.col(c)).alias(h))
    return b.select(*out)


# ---------------------------------------------------------------------------
# Working papers per company (expense sheets), templates and cell updates.
# ---------------------------------------------------------------------------

EXPENSE_HEADER_ROWS = {"销售费用": 1, "管理费用": 67, "研发费用": 137}
YOY_HEADER_ROWS = {"销售费用": 93, "管理费用": 126, "研发费用": 159}
# Lines of an area that a paper's read ranges hold; further lines go to further
# papers of the company, so that every line is within a range.
EXPENSE_LINES, YOY_LINES = 60, 30


def _block(headers: dict, lines: int):
    """File and sheet row of line ``rn`` of an area: below the area's header in
    the company's paper number ``(rn - 1) div lines``."""
    hdr = F.create_map(*[x for a, r in headers.items() for x in (F.lit(a), F.lit(r))])
    no = F.floor((F.col("rn") - 1) / lines)
    file = F.when(no > 0, F.concat("file_name", F.lit("_"), no.cast("string"))).otherwise(F.col("file_name"))
    return file.alias("file_name"), (hdr[F.col("func_area")] + 1 + (F.col("rn") - 1) % lines).cast("int").alias("row_no")


def paper_file(name_col, region_col):
    """Paper file name per company; some names carry the fragments that the
    file-name rules exclude."""
    return (F.when(F.col(region_col) == 4, F.concat(F.col(name_col), F.lit("公司小合并2024")))
            .when(F.col(region_col) == 3, F.concat(F.col(name_col), F.lit("公司日志")))
            .otherwise(F.concat(F.col(name_col), F.lit("公司2024"))))


def paper_names(spark: SparkSession, d: str) -> DataFrame:
    """``(company, paper)`` of every nation."""
    n = table(spark, d, "nation").select("n_name", "n_regionkey")
    return n.select(F.col("n_name").alias("company"), paper_file("n_name", "n_regionkey").alias("paper"))


def paper_rows(spark: SparkSession, d: str) -> DataFrame:
    """Expense sheets ('8_费用' audited lines, '8' year-on-year lines) of each
    company's working paper, filled from the ledger summary."""
    from tallyspark.operators import ledger as L
    from pyspark.sql.window import Window
    summ = L.expense_summary(L.parse_ledger(ledger(spark, d)))
    n = table(spark, d, "nation").select("n_name", "n_regionkey")
    w = Window.partitionBy("company", "func_area").orderBy("gl_text")  # bounded: one row per GL text
    lines = (summ.withColumn("rn", F.row_number().over(w))
             .join(n, F.col("company") == F.col("n_name"))
             .withColumn("file_name", paper_file("n_name", "n_regionkey")))
    amt = F.col("amount").cast("string")
    exp_file, exp_row = _block(EXPENSE_HEADER_ROWS, EXPENSE_LINES)
    yoy_file, yoy_row = _block(YOY_HEADER_ROWS, YOY_LINES)
    exp = lines.select(
        exp_file, F.lit("8_费用").alias("sheet"), exp_row,
        F.array(F.col("func_area"), F.concat(F.lit("66"), F.lpad(F.col("rn").cast("string"), 2, "0")),
                F.col("gl_text"), F.col("func_area"),
                F.when(F.col("rn") % 7 == 0, F.lit(None)).otherwise(amt), F.lit(None).cast("string"),
                F.lit("0.00")).alias("cells"))
    prior = F.round(F.col("amount") * F.lit("0.9").cast("decimal(10,4)"), 2).cast(MONEY).cast("string")
    yoy = lines.select(
        yoy_file, F.lit("8").alias("sheet"), yoy_row,
        F.array(F.col("gl_text"), amt, prior).alias("cells"))
    files = lines.select(exp_file).union(lines.select(yoy_file)).distinct()
    exp_hdr = F.array(*[F.lit(x) for x in ["类别", "科目编码", "底稿科目", "附注分类", "本期未审", "重分类调整", "审计调整"]])
    yoy_hdr = F.array(*[F.lit(x) for x in ["项目", "本期发生额", "上期发生额"]])
    heads = files.select("file_name", F.inline(F.array(
        *[F.struct(F.lit("8_费用").alias("sheet"), F.lit(r).alias("row_no"), exp_hdr.alias("cells"))
          for r in EXPENSE_HEADER_ROWS.values()],
        *[F.struct(F.lit("8").alias("sheet"), F.lit(r).alias("row_no"), yoy_hdr.alias("cells"))
          for r in YOY_HEADER_ROWS.values()])))
    return exp.unionByName(yoy).unionByName(heads.select("file_name", "sheet", F.col("row_no").cast("int"), "cells"))


# Fixed test template: the audited-table sheet of the expense template workbook.
AUDIT_TEMPLATE = [
    (1, 0, "审定表"), (2, 0, "被审计单位"), (8, 0, "公司"), (8, 1, "科目编码"), (8, 2, "底稿科目"),
    (8, 3, "附注分类"), (8, 4, "本期未审"), (8, 5, "重分类调整"), (8, 6, "审计调整"),
    (10, 0, "样式行"), (11, 0, "合计"), (12, 0, "编制人"),
]


# Fixed test template: the year-on-year sheet of the expense template workbook.
YOY_TEMPLATE = [
    (1, 0, "同期比较"), (8, 0, "公司"), (8, 1, "项目"), (8, 2, "本期发生额"), (8, 4, "上期发生额"),
    (10, 0, "样式行"), (11, 0, "合计"),
]


def audit_template(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AUDIT_TEMPLATE, "row_no int, col_no int, value string")


def yoy_template(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(YOY_TEMPLATE, "row_no int, col_no int, value string")


def paper_updates(spark: SparkSession, d: str) -> DataFrame:
    """Cell updates for the papers: the ledger lines placed at the fixed
    starts (seq 1), plus a later duplicate and a null overwrite (seq 2)."""
    from tallyspark.operators import ledger as L
    placed = L.place_fixed(L.expense_summary(L.parse_ledger(ledger(spark, d))))
    n = table(spark, d, "nation").select("n_name", "n_regionkey")
    p = placed.join(n, F.col("company") == F.col("n_name"))
    from tallyspark.functions.exprs import cell_ref_col, cell_ref_row
    base = p.select(paper_file("n_name", "n_regionkey").alias("file_name"), "sheet",
                    cell_ref_row("cell").alias("row_no"), cell_ref_col("cell").alias("col_no"),
                    F.coalesce(F.col("text"), F.col("amount").cast("string")).alias("value"),
                    F.lit(1).alias("seq"))
    files = base.select("file_name").distinct()
    extra = files.select("file_name", F.inline(F.array(
        F.struct(F.lit("8_费用").alias("sheet"), F.lit(2).alias("row_no"), F.lit(2).alias("col_no"),
                 F.lit("改写").alias("value"), F.lit(2).alias("seq")),
        F.struct(F.lit("8_费用").alias("sheet"), F.lit(3).alias("row_no"), F.lit(6).alias("col_no"),
                 F.lit(None).cast("string").alias("value"), F.lit(2).alias("seq")))))
    return base.unionByName(extra.select("file_name", "sheet", F.col("row_no").cast("int"),
                                         F.col("col_no").cast("int"), "value", F.col("seq").cast("int")))


def rule_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rule table as the sheets of a mapping workbook: a title row, the
    header in row 2 (extra columns first), one rule per row below."""
    from pyspark.sql.window import Window
    r = rules(spark, d)
    w = Window.partitionBy("sheet").orderBy("cell", "accts")  # a config table: small groups
    body = r.select(F.lit("mapping").alias("file_name"), "sheet",
                    (F.row_number().over(w) + 2).cast("int").alias("row_no"),
                    F.array(F.lit(None).cast("string"), F.lit("项目"), "cell", "accts", "ops", "items").alias("cells"))
    sheets = r.select("sheet").distinct()
    head = sheets.select(F.lit("mapping").alias("file_name"), "sheet", F.inline(F.array(
        F.struct(F.lit(1).alias("row_no"), F.array(F.lit("单元格映射表")).alias("cells")),
        F.struct(F.lit(2).alias("row_no"),
                 F.array(*[F.lit(x) for x in ["行次", "项目名称", "单元格", "账户代码", "运算符", "金额列"]]).alias("cells")))))
    return body.unionByName(head.select("file_name", "sheet", F.col("row_no").cast("int"), "cells"))


def supplier_scope(spark: SparkSession, d: str) -> DataFrame:
    """Scope rows for the per-supplier statement files: report name = the
    supplier's file name; foreign-currency flag from the supplier's nation
    region (as in :func:`scope`)."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("s_suppkey").cast("bigint").alias("serial"), F.col("s_name").alias("company"),
                    F.col("s_name").alias("report_name"),
                    F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sap_code"),
                    F.when(F.col("n_regionkey") == 1, "是").when(F.col("n_regionkey") == 2, F.lit(None))
                    .otherwise("否").alias("fx_flag"),
                    F.col("s_suppkey").cast("bigint").alias("seq")))
