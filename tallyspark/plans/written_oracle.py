"""DuckDB SQL of the keys that write and read back (``plans/written.py``)."""

from __future__ import annotations

from tallyspark.plans.oracle import (BAL_A, BAL_B, CP_BASE, LEDGER, ORACLE, SCOPE, STMT, TB, _B_OUT, _GROUP, with_)

_AT = {"CF2": [(11, "name"), (12, "nature"), (13, "a1"), (14, "a2"), (15, "a3"), (16, "amt"), (27, "cur"), (30, "name"), (31, "nature"),
               (32, "a1"), (33, "a2"), (34, "a3"), (35, "amt"), (43, "cur")],
       "应收账款": [(0, "code_ar"), (1, "name"), (2, "flag"), (4, "a1"), (5, "cur"), (6, "amt"), (7, "amt"), (16, "a3"), (17, "'x'")]}

ORACLE["scan_workbook_cells"] = with_(CP_BASE) + "\nUNION ALL\n".join(
    f"SELECT file_name, '{sheet}' AS sheet, row_no, CAST({i} AS BIGINT) AS col_no, {v} AS value FROM cp WHERE {v} IS NOT NULL"
    for sheet, at in _AT.items() for i, v in at)

ORACLE["scan_workbook_counts"] = with_(CP_BASE) + """
SELECT file_name, sheet, count(*) + any_value(banner) AS n_rows, CAST(0 AS BIGINT) AS n_errors
FROM cp, (VALUES ('CF2', 3), ('应付账款', 4), ('预付账款', 4), ('其他非流动资产', 4), ('应收账款', 3), ('预收账款', 3)) s(sheet, banner)
GROUP BY file_name, sheet
UNION ALL SELECT concat('坏', n_name), NULL, 0, 1 FROM nation"""

ORACLE["replace_table"] = with_(TB, BAL_A) + """
SELECT company, acct_code, CAST(closing AS DOUBLE) AS closing, CAST(1 AS BIGINT) AS version FROM bal_a
UNION ALL SELECT company, acct_code, CAST(closing AS DOUBLE), 2 FROM bal_a WHERE length(acct_code) = 4"""

ORACLE["split_statements_written"] = "SELECT *, count(*) OVER (PARTITION BY company) AS part_rows FROM (" + ORACLE["split_statements"] + ") s"

ORACLE["split_ledger_written"] = with_(TB, LEDGER, SCOPE)[:-1] + """
, names AS (SELECT sap_code, report_name FROM (
   SELECT *, row_number() OVER (PARTITION BY sap_code ORDER BY seq DESC) AS rn FROM scope) t WHERE rn = 1)
, lines AS (SELECT n.report_name, n.sap_code AS company_code, l.company, l.func_area, l.gl_text, CAST(l.amount AS DOUBLE) AS amount
            FROM names n JOIN ledger_parsed l ON n.sap_code = l.company_code)
SELECT *, count(*) OVER (PARTITION BY report_name) AS part_rows FROM lines
UNION ALL SELECT DISTINCT report_name, NULL, NULL, NULL, NULL, NULL, 0 FROM names WHERE report_name NOT IN (SELECT report_name FROM lines)"""

ORACLE["split_balances_written"] = "SELECT *, count(*) OVER (PARTITION BY company) AS part_rows FROM (" + with_(TB, BAL_B) + _B_OUT + " FROM bal_b) s"

ORACLE["read_one_part"] = with_(TB, BAL_B) + """
SELECT company, acct_code, currency, CAST(lc_closing AS DOUBLE) AS lc_closing FROM bal_b WHERE company = 'NATION_3'"""

ORACLE["write_recon_log"] = """
SELECT r.company, r.acct_code, r.closing, r.diff, CAST(CASE WHEN n.n_regionkey = 1 THEN 2 ELSE 1 END AS BIGINT) AS run
FROM (""" + ORACLE["reconcile"] + """) r JOIN nation n ON n.n_name = r.company
WHERE n.n_regionkey NOT IN (1, 2) OR (n.n_regionkey = 1 AND abs(r.diff) > 1000000)"""

_UNLIKE = """
SELECT {file}, acct_code, CASE WHEN n_regionkey <= 1 THEN acct_name END AS acct_name,
 CASE WHEN n_regionkey >= 3 THEN company END AS company, CASE WHEN n_regionkey <> 2 THEN CAST(opening AS DOUBLE) END AS opening,
 CASE WHEN n_regionkey <= 1 THEN CAST(period_debit AS DOUBLE) END AS period_debit, CAST(closing AS DOUBLE) AS closing
FROM bal_a JOIN nation ON n_name = company"""
ORACLE["scan_many_columns"] = with_(TB, BAL_A) + _UNLIKE.format(file="company AS file_company")
ORACLE["export_merged"] = with_(TB, BAL_A) + _UNLIKE.format(file='company AS "文件名"')

ORACLE["single_sheet_metrics"] = with_(TB) + """
SELECT count(DISTINCT company) + 1 AS files, count(DISTINCT company) + 2 AS sheets, CAST(1 AS BIGINT) AS violations FROM tb"""

ORACLE["read_ledger_csv"] = with_(TB, LEDGER) + """
SELECT company_code, func_area, CASE WHEN length(gl_text) % 3 = 0 THEN concat('"', gl_text, '",', chr(10), func_area) ELSE gl_text END AS gl_text,
 CAST(amount AS DOUBLE) AS amount FROM ledger_parsed"""

ORACLE["ledger_csv_rejects"] = """
SELECT concat('X', n_nationkey) AS first_field, concat('X', n_nationkey, ',销售费用,a,1.00,', n_name) AS line FROM nation"""

ORACLE["update_papers"] = ORACLE["apply_cell_updates"].replace(
    "FULL OUTER JOIN latest u", "FULL OUTER JOIN (SELECT * FROM latest WHERE file_name IN (SELECT concat(n_name, '公司2024') FROM nation WHERE n_regionkey <= 1)) u")

ORACLE["ingest_statements_income"] = ORACLE["drop_contains"]
