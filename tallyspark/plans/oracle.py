"""DuckDB oracle SQL per inventory key, written in plain SQL from the
code (row-wise formulations where the Spark side aggregates first, cross
joins where the Spark side explodes bounded lists).

Fixture CTEs mirror FIXTURES.md; money leaves as DOUBLE, integers as BIGINT.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------------------
# Fixture CTEs
# ---------------------------------------------------------------------------

TB = """
tb AS (
 WITH base AS (
  SELECT n.n_name AS company,
   CASE p.p_type WHEN 'ECONOMY' THEN '1' WHEN 'STANDARD' THEN '2' WHEN 'SMALL' THEN '4' WHEN 'MEDIUM' THEN '5' ELSE '6' END AS cls,
   CAST(1 + p.p_size % 5 AS VARCHAR) AS l1, CAST(1 + p.p_partkey % 4 AS VARCHAR) AS l2,
   CASE WHEN l.l_linestatus='O' THEN 'CNY' ELSE 'USD' END AS currency,
   CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amt, l.l_shipdate AS d, l.l_returnflag AS rf
  FROM lineitem l JOIN part p ON l.l_partkey=p.p_partkey JOIN supplier s ON l.l_suppkey=s.s_suppkey
  JOIN nation n ON s.s_nationkey=n.n_nationkey)
 SELECT company, concat(cls,'00',l1,'0',l2) AS acct_code, concat('A',cls,'00',l1,'-S',l2) AS acct_name, currency,
  CAST(SUM(CASE WHEN d < TIMESTAMP '1998-01-01 00:00:00' THEN amt ELSE 0 END) AS DECIMAL(18,2)) AS opening,
  CAST(SUM(CASE WHEN d >= TIMESTAMP '1998-01-01 00:00:00' AND rf<>'R' THEN amt ELSE 0 END) AS DECIMAL(18,2)) AS debit,
  CAST(SUM(CASE WHEN d >= TIMESTAMP '1998-01-01 00:00:00' AND rf='R' THEN amt ELSE 0 END) AS DECIMAL(18,2)) AS credit,
  CAST(SUM(CASE WHEN d < TIMESTAMP '1998-01-01 00:00:00' THEN amt WHEN rf='R' THEN -amt ELSE amt END) AS DECIMAL(18,2)) AS closing
 FROM base GROUP BY 1,2,3,4)"""

BAL_A = """
bal_a AS (
 WITH u AS (
  SELECT company, acct_code, acct_name, sum(opening) o, sum(debit) dr, sum(credit) cr, sum(closing) z FROM tb GROUP BY 1,2,3
  UNION ALL
  SELECT company, left(acct_code,4), split_part(acct_name,'-',1), sum(opening), sum(debit), sum(credit), sum(closing) FROM tb GROUP BY 1,2,3)
 SELECT company, acct_code, acct_name,
  CASE WHEN o>0 THEN '借' WHEN o<0 THEN '贷' ELSE '平' END AS open_dir,
  CAST(o AS DECIMAL(18,2)) AS opening,
  CAST(CASE WHEN o>0 THEN o END AS DECIMAL(18,2)) AS open_debit,
  CAST(CASE WHEN o<0 THEN -o END AS DECIMAL(18,2)) AS open_credit,
  CAST(dr AS DECIMAL(18,2)) AS period_debit,
  CAST(cr AS DECIMAL(18,2)) AS period_credit,
  CAST(dr AS DECIMAL(18,2)) AS ytd_debit,
  CAST(CASE WHEN cr<>0 THEN cr END AS DECIMAL(18,2)) AS ytd_credit,
  CASE WHEN z>0 THEN '借' WHEN z<0 THEN '贷' ELSE '平' END AS close_dir,
  CAST(z AS DECIMAL(18,2)) AS closing,
  CAST(CASE WHEN z>0 THEN z END AS DECIMAL(18,2)) AS close_debit,
  CAST(CASE WHEN z<0 THEN -z END AS DECIMAL(18,2)) AS close_credit
 FROM u)"""

RULES = """
rules AS (
 SELECT sheet, concat('E', CAST(row_number() OVER (PARTITION BY sheet ORDER BY l1) + 4 AS VARCHAR)) AS cell,
  concat(l1,'01|',l1,'02|',l1,'09') AS accts, '+|-|_' AS ops,
  '期末余额_金额|期间发生额_贷方金额|期末余额_金额' AS items
 FROM (SELECT DISTINCT left(acct_code,4) AS l1,
        CASE left(acct_code,1) WHEN '1' THEN '1' WHEN '2' THEN '2' WHEN '4' THEN '4' WHEN '5' THEN '8' ELSE '原报表' END AS sheet
       FROM tb) t
 UNION ALL
 SELECT '8_费用', concat('E', CAST(CASE WHEN c='6' THEN 29 ELSE 140 END + row_number() OVER (PARTITION BY c ORDER BY l1) AS VARCHAR)),
  concat(l1,'01'), '+', '期间发生额_借方金额'
 FROM (SELECT DISTINCT left(acct_code,4) AS l1, left(acct_code,1) AS c FROM tb WHERE left(acct_code,1) IN ('5','6')) f
 UNION ALL
 SELECT * FROM (VALUES
  ('1','E90','100101|100102','+|x','期末余额_金额|期末余额_金额'),
  ('1','E91','100101',NULL,'期末余额_金额'),
  ('1','E91','100102','+','期末余额_金额'),
  ('1','E92',NULL,'+','期末余额_金额'),
  ('1','E93','100101','+','期初余额_金额'),
  ('1','E94','100101|100102','+|-|+','期末余额_金额|期末余额_金额'),
  ('1','E95','100201',' +','期末余额_金额'),
  ('2','E96',' 200101 | 200102','+|-','期末余额_金额 | 期末余额_金额'),
  ('原报表','E97','600101','+',NULL)) v(sheet, cell, accts, ops, items))"""

RATES = """
rates AS (SELECT * FROM (VALUES ('1', CAST(7.1884 AS DECIMAL(10,4))), ('2', 7.1884), ('4', 7.1884), ('4.1_递延', 7.1884),
  ('5', 7.1884), ('6', 7.1884), ('8', 7.1140)) v(sheet, rate))"""

# Exploded rule parts (pipe rows split in step; plain rows pass through).
PARTS_RAW = """
split_src AS (
 SELECT sheet, replace(cell, chr(10), '') AS cell,
  string_split(replace(accts, chr(10), ''), '|') AS a,
  string_split(replace(ops, chr(10), ''), '|') AS o,
  string_split(replace(items, chr(10), ''), '|') AS i
 FROM rules
 WHERE accts LIKE '%|%' AND cell IS NOT NULL AND ops IS NOT NULL AND items IS NOT NULL),
split_idx AS (
 SELECT sheet, cell, a, o, i, unnest(generate_series(1, len(a))) AS k
 FROM split_src WHERE len(a) = len(o) AND len(a) = len(i)),
parts_raw AS (
 SELECT sheet, trim(cell) AS cell, trim(a[k]) AS acct_code, o[k] AS op, trim(i[k]) AS item, k - 1 AS part_no
 FROM split_idx
 UNION ALL
 SELECT sheet, trim(cell), trim(accts), ops, trim(items), 0
 FROM rules WHERE accts IS NULL OR accts NOT LIKE '%|%')"""

PARTS_SIGNED = """
parts_signed AS (
 SELECT sheet, cell, acct_code, item, part_no,
  CASE WHEN op IS NULL OR op = '' THEN 0 WHEN op = '+' THEN 1 WHEN op IN ('-','_') THEN -1 END AS sign
 FROM parts_raw)"""

PARTS = """
parts AS (
 SELECT * FROM parts_signed
 WHERE NOT coalesce(item LIKE '%期初余额%', false)
   AND (sheet = '原报表' OR (acct_code IS NOT NULL AND item IS NOT NULL)))"""

LONG_A = """
long_a AS (
 UNPIVOT (SELECT company, acct_code, acct_name, open_dir, close_dir,
   opening AS "期初余额_金额", open_debit AS "期初余额_借方金额", open_credit AS "期初余额_贷方金额",
   period_debit AS "期间发生额_借方金额", period_credit AS "期间发生额_贷方金额",
   ytd_debit AS "累计发生额_借方金额", ytd_credit AS "累计发生额_贷方金额",
   closing AS "期末余额_金额", close_debit AS "期末余额_借方金额", close_credit AS "期末余额_贷方金额" FROM bal_a)
 ON "期初余额_金额", "期初余额_借方金额", "期初余额_贷方金额", "期间发生额_借方金额", "期间发生额_贷方金额",
    "累计发生额_借方金额", "累计发生额_贷方金额", "期末余额_金额", "期末余额_借方金额", "期末余额_贷方金额"
 INTO NAME item VALUE amount)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


BASE_RULES = with_(TB, RULES, PARTS_RAW, PARTS_SIGNED, PARTS)
BASE_A = with_(TB, BAL_A, RULES, PARTS_RAW, PARTS_SIGNED, PARTS, LONG_A, RATES)

# ---------------------------------------------------------------------------
# Rules
# ---------------------------------------------------------------------------

ORACLE["explode_pipe_rules"] = BASE_RULES + """
SELECT sheet, cell, acct_code, op, item, CAST(part_no AS BIGINT) AS part_no FROM parts_raw"""

ORACLE["op_to_sign"] = BASE_RULES + """
SELECT sheet, cell, acct_code, item, CAST(part_no AS BIGINT) AS part_no, CAST(sign AS BIGINT) AS sign FROM parts_signed"""

ORACLE["drop_opening_rules"] = BASE_RULES + """
SELECT sheet, cell, acct_code, item, CAST(part_no AS BIGINT) AS part_no, CAST(sign AS BIGINT) AS sign FROM parts"""

ORACLE["select_sheets"] = BASE_RULES + """
SELECT sheet, cell, acct_code, item, CAST(part_no AS BIGINT) AS part_no, CAST(sign AS BIGINT) AS sign
FROM parts WHERE sheet IN ('原报表', '1')"""

# ---------------------------------------------------------------------------
# Balances
# ---------------------------------------------------------------------------

ORACLE["unpivot_a"] = BASE_A + """
SELECT company, acct_code, acct_name, open_dir, close_dir, item, CAST(amount AS DOUBLE) AS amount FROM long_a"""

ORACLE["account_class"] = BASE_A + """
SELECT company, acct_code,
 CASE WHEN left(acct_code,1)='1' THEN '资产' WHEN left(acct_code,1)='2' THEN '负债'
      WHEN left(acct_code,1)='4' THEN '权益' WHEN left(acct_code,1)='5' THEN '成本'
      WHEN left(acct_code,1)='6' THEN '损益' END AS account_class
FROM bal_a"""

ORACLE["distinct_companies"] = BASE_A + "SELECT DISTINCT company FROM bal_a"

# ---------------------------------------------------------------------------
# Cells: per company, rules LEFT JOIN balances, grouped by cell.
# ---------------------------------------------------------------------------

_COMPANY_RULES = """
, comp AS (SELECT DISTINCT company FROM long_a)
, per_company AS (SELECT c.company, p.* FROM comp c CROSS JOIN parts p)
"""

ORACLE["join_rules_balances"] = BASE_A[:-1] + _COMPANY_RULES + """
SELECT a.company, a.sheet, a.cell, a.acct_code, a.item, CAST(a.part_no AS BIGINT) AS part_no,
 CAST(a.sign AS BIGINT) AS sign, CAST(b.amount AS DOUBLE) AS amount
FROM per_company a LEFT JOIN long_a b
 ON a.company = b.company AND a.acct_code = b.acct_code AND a.item = b.item"""

_CELLS = """
, cells0 AS (
 SELECT a.company, a.sheet, a.cell, round(sum(b.amount * a.sign), 2) AS amt
 FROM per_company a LEFT JOIN long_a b
  ON a.company = b.company AND a.acct_code = b.acct_code AND a.item = b.item
 GROUP BY a.company, a.sheet, a.cell)
, cells_norate AS (SELECT company, sheet, cell, CAST(coalesce(amt, 0) AS DECIMAL(18,2)) AS amount FROM cells0)
, cells_rate AS (
 SELECT c.company, c.sheet, c.cell,
  CAST(round(c.amount * coalesce(r.rate, CAST(1 AS DECIMAL(10,4))), 2) AS DECIMAL(18,2)) AS amount
 FROM cells_norate c LEFT JOIN rates r ON c.sheet = r.sheet)
"""


def _zeroed(src: str) -> str:
    return f"""
, flags AS (
 SELECT company,
  coalesce(sum(CASE WHEN cell IN ({', '.join(f"'E{i}'" for i in range(31, 50))}) THEN amount END), 0) AS s1,
  coalesce(sum(CASE WHEN cell IN ({', '.join(f"'E{i}'" for i in range(142, 148))}) THEN amount END), 0) AS s2
 FROM {src} WHERE sheet = '8_费用' GROUP BY company)
, zeroed AS (
 SELECT c.company, c.sheet, c.cell,
  CASE WHEN c.sheet = '8_费用' AND f.s1 <> 0 AND c.cell = 'E30' THEN 0
       WHEN c.sheet = '8_费用' AND f.s1 = 0 AND f.s2 <> 0 AND c.cell = 'E141' THEN 0
       ELSE c.amount END AS amount
 FROM {src} c LEFT JOIN flags f ON c.company = f.company)
"""


ORACLE["cell_amounts"] = BASE_A[:-1] + _COMPANY_RULES + _CELLS + """
SELECT company, sheet, cell, CAST(amount AS DOUBLE) AS amount FROM cells_norate"""

ORACLE["rate_by_sheet"] = BASE_A[:-1] + _COMPANY_RULES + _CELLS + """
SELECT company, sheet, cell, CAST(amount AS DOUBLE) AS amount FROM cells_rate"""

ORACLE["conditional_zero"] = BASE_A[:-1] + _COMPANY_RULES + _CELLS + _zeroed("cells_norate") + """
SELECT company, sheet, cell, CAST(amount AS DOUBLE) AS amount FROM zeroed"""

ORACLE["tb_to_cells"] = BASE_A[:-1] + _COMPANY_RULES + _CELLS + _zeroed("cells_rate") + """
SELECT company, sheet, cell, CAST(amount AS DOUBLE) AS amount FROM zeroed"""

# ---------------------------------------------------------------------------
# Reconciliation (statement-sheet rules only).
# ---------------------------------------------------------------------------

_MAPPED = """
, stmt_parts AS (SELECT * FROM parts WHERE sheet = '原报表')
, mapped AS (
 SELECT b.company, left(a.acct_code, 4) AS acct_code, coalesce(round(sum(b.amount * a.sign), 2), 0) AS amount
 FROM stmt_parts a LEFT JOIN long_a b ON a.acct_code = b.acct_code AND a.item = b.item
 WHERE b.amount IS NOT NULL
 GROUP BY b.company, left(a.acct_code, 4))
"""

_CLASS = """CASE WHEN left(acct_code,1)='1' THEN '资产' WHEN left(acct_code,1)='2' THEN '负债'
      WHEN left(acct_code,1)='4' THEN '权益' WHEN left(acct_code,1)='5' THEN '成本'
      WHEN left(acct_code,1)='6' THEN '损益' END"""

ORACLE["join_matched_only"] = BASE_A + """
SELECT b.company, a.acct_code, a.item, CAST(b.amount AS DOUBLE) AS amount, a.sheet, a.cell,
 CAST(a.part_no AS BIGINT) AS part_no, CAST(a.sign AS BIGINT) AS sign
FROM parts a LEFT JOIN long_a b ON a.acct_code = b.acct_code AND a.item = b.item
WHERE b.amount IS NOT NULL"""

ORACLE["mapped_by_l1"] = BASE_A[:-1] + _MAPPED + f"""
SELECT company, acct_code, CAST(amount AS DOUBLE) AS amount, {_CLASS} AS account_class FROM mapped"""

ORACLE["reconcile"] = BASE_A[:-1] + _MAPPED + f"""
SELECT company, acct_code, acct_name, close_dir, closing, diff, {_CLASS} AS account_class FROM (
 SELECT a.company, a.acct_code, a.acct_name, a.close_dir, CAST(a.amount AS DOUBLE) AS closing,
  CAST(abs(a.amount) - abs(b.amount) AS DOUBLE) AS diff
 FROM long_a a LEFT JOIN mapped b ON a.company = b.company AND a.acct_code = b.acct_code
 WHERE a.item = '期末余额_金额' AND length(a.acct_code) = 4
   AND (b.acct_code IS NULL OR abs(a.amount) - abs(b.amount) <> 0)) t"""

# ---------------------------------------------------------------------------
# Layout B
# ---------------------------------------------------------------------------

BAL_B = """
bal_b AS (
 SELECT company, acct_code, acct_name, currency,
  CAST(CASE WHEN currency='USD' THEN opening END AS DECIMAL(18,2)) AS fc_opening,
  CAST(CASE WHEN currency='USD' THEN debit END AS DECIMAL(18,2)) AS fc_debit,
  CAST(CASE WHEN currency='USD' THEN credit END AS DECIMAL(18,2)) AS fc_credit,
  CAST(CASE WHEN currency='USD' THEN closing END AS DECIMAL(18,2)) AS fc_closing,
  'CNY' AS local_currency,
  CAST(round(CASE WHEN currency='USD' THEN opening * CAST(7.1884 AS DECIMAL(10,4)) ELSE opening END, 2) AS DECIMAL(18,2)) AS lc_opening,
  CAST(round(CASE WHEN currency='USD' THEN debit * CAST(7.1884 AS DECIMAL(10,4)) ELSE debit END, 2) AS DECIMAL(18,2)) AS lc_debit,
  CAST(round(CASE WHEN currency='USD' THEN credit * CAST(7.1884 AS DECIMAL(10,4)) ELSE credit END, 2) AS DECIMAL(18,2)) AS lc_credit,
  CAST(round(CASE WHEN currency='USD' THEN closing * CAST(7.1884 AS DECIMAL(10,4)) ELSE closing END, 2) AS DECIMAL(18,2)) AS lc_closing
 FROM tb)"""


def _rollup(n: int, skip: bool = False) -> str:
    where = f"WHERE length(acct_code) > {n}" if skip else ""
    return f"""
 SELECT company, acct_code, acct_name, currency, fc_opening, fc_debit, fc_credit, fc_closing,
  local_currency, lc_opening, lc_debit, lc_credit, lc_closing FROM bal_b
 UNION ALL
 SELECT company, left(acct_code, {n}) AS acct_code, split_part(acct_name, '-', 1) AS acct_name, currency,
  CAST(sum(fc_opening) AS DECIMAL(18,2)), CAST(sum(fc_debit) AS DECIMAL(18,2)), CAST(sum(fc_credit) AS DECIMAL(18,2)),
  CAST(sum(fc_closing) AS DECIMAL(18,2)), local_currency,
  CAST(sum(lc_opening) AS DECIMAL(18,2)), CAST(sum(lc_debit) AS DECIMAL(18,2)), CAST(sum(lc_credit) AS DECIMAL(18,2)),
  CAST(sum(lc_closing) AS DECIMAL(18,2))
 FROM bal_b {where}
 GROUP BY company, left(acct_code, {n}), split_part(acct_name, '-', 1), currency, local_currency"""


_B_OUT = """SELECT company, acct_code, acct_name, currency,
 CAST(fc_opening AS DOUBLE) AS fc_opening, CAST(fc_debit AS DOUBLE) AS fc_debit, CAST(fc_credit AS DOUBLE) AS fc_credit,
 CAST(fc_closing AS DOUBLE) AS fc_closing, local_currency,
 CAST(lc_opening AS DOUBLE) AS lc_opening, CAST(lc_debit AS DOUBLE) AS lc_debit, CAST(lc_credit AS DOUBLE) AS lc_credit,
 CAST(lc_closing AS DOUBLE) AS lc_closing"""

ORACLE["prefix_rollup"] = with_(TB, BAL_B) + _B_OUT + f" FROM ({_rollup(4)}) t"
ORACLE["prefix_rollup_collide"] = with_(TB, BAL_B) + _B_OUT + f" FROM ({_rollup(6)}) t"
ORACLE["prefix_rollup_skip_existing"] = with_(TB, BAL_B) + _B_OUT + f" FROM ({_rollup(6, True)}) t"

LONG_B = f"""
rolled_b AS ({_rollup(4)}),
long_b AS (
 UNPIVOT (SELECT company, acct_code, acct_name, currency, local_currency,
   lc_opening AS "本位币货币期初", lc_debit AS "本位货币借方", lc_credit AS "本位货币贷方", lc_closing AS "本位货币期末",
   fc_opening AS "外币期初", fc_debit AS "外币借方", fc_credit AS "外币贷方", fc_closing AS "外币期末" FROM rolled_b)
 ON "本位币货币期初", "本位货币借方", "本位货币贷方", "本位货币期末", "外币期初", "外币借方", "外币贷方", "外币期末"
 INTO NAME item VALUE amount)"""

ORACLE["unpivot_b"] = with_(TB, BAL_B, LONG_B) + """
SELECT company, acct_code, acct_name, currency, local_currency, item, CAST(amount AS DOUBLE) AS amount FROM long_b"""

RULES_B = """
rules AS (
 SELECT sheet, cell, accts, ops,
  replace(replace(replace(replace(items, '期末余额_金额', '本位货币期末'), '期间发生额_贷方金额', '本位货币贷方'),
          '期间发生额_借方金额', '本位货币借方'), '期初余额_金额', '本位币货币期初') AS items
 FROM rules_a)"""

ORACLE["tb_to_cells_b"] = (with_(TB, BAL_B, LONG_B, RULES.replace("rules AS (", "rules_a AS (", 1), RULES_B,
                                 PARTS_RAW, PARTS_SIGNED, PARTS, RATES)[:-1] + """
, comp AS (SELECT DISTINCT company FROM long_b)
, per_company AS (SELECT c.company, p.* FROM comp c CROSS JOIN parts p)
, cells0 AS (
 SELECT a.company, a.sheet, a.cell, round(sum(b.amount * a.sign), 2) AS amt
 FROM per_company a LEFT JOIN long_b b ON a.company = b.company AND a.acct_code = b.acct_code AND a.item = b.item
 GROUP BY a.company, a.sheet, a.cell)
, cells_rate AS (
 SELECT c.company, c.sheet, c.cell,
  CAST(round(CAST(coalesce(c.amt, 0) AS DECIMAL(18,2)) * coalesce(r.rate, CAST(1 AS DECIMAL(10,4))), 2) AS DECIMAL(18,2)) AS amount
 FROM cells0 c LEFT JOIN rates r ON c.sheet = r.sheet)
""" + _zeroed("cells_rate") + """
SELECT company, sheet, cell, CAST(amount AS DOUBLE) AS amount FROM zeroed""")

# Sheet-row readers: reading the exported rows back must give the tables.
ORACLE["assert_single_sheet"] = with_(TB) + """
SELECT company AS file_name, CAST(1 AS BIGINT) AS n_sheets, true AS ok FROM (SELECT DISTINCT company FROM tb) t
UNION ALL SELECT 'MULTI', CAST(2 AS BIGINT), false"""

ORACLE["read_balance_a"] = with_(TB, BAL_A) + """
SELECT company, acct_code, acct_name, open_dir, CAST(opening AS DOUBLE) AS opening,
 CAST(open_debit AS DOUBLE) AS open_debit, CAST(open_credit AS DOUBLE) AS open_credit,
 CAST(period_debit AS DOUBLE) AS period_debit, CAST(period_credit AS DOUBLE) AS period_credit,
 CAST(ytd_debit AS DOUBLE) AS ytd_debit, CAST(ytd_credit AS DOUBLE) AS ytd_credit, close_dir,
 CAST(closing AS DOUBLE) AS closing, CAST(close_debit AS DOUBLE) AS close_debit, CAST(close_credit AS DOUBLE) AS close_credit
FROM bal_a"""

ORACLE["read_balance_b"] = with_(TB, BAL_B) + _B_OUT + " FROM bal_b"

ORACLE["load_base"] = ORACLE["conditional_zero"]

# ---------------------------------------------------------------------------
# Ledger and scope
# ---------------------------------------------------------------------------

LEDGER = """
ledger AS (
 SELECT n.n_name AS company, concat('C', lpad(CAST(n.n_nationkey AS VARCHAR), 4, '0')) AS company_code,
  CASE p.p_type WHEN 'ECONOMY' THEN '销售费用' WHEN 'STANDARD' THEN '管理费用' WHEN 'SMALL' THEN '研发费用' ELSE '生产成本' END AS func_area,
  p.p_name AS gl_text,
  concat(CASE WHEN l_extendedprice >= 1000 THEN concat(CAST(CAST(FLOOR(l_extendedprice/1000) AS INT) AS VARCHAR), ',',
           lpad(CAST(CAST(FLOOR(l_extendedprice) AS INT) % 1000 AS VARCHAR),3,'0'))
         ELSE CAST(CAST(FLOOR(l_extendedprice) AS INT) AS VARCHAR) END,
   '.', lpad(CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2))*100 AS BIGINT) % 100 AS VARCHAR),2,'0'),
   CASE WHEN l_returnflag='R' THEN '-' ELSE '' END) AS amount_text
 FROM lineitem l JOIN part p ON l.l_partkey=p.p_partkey JOIN supplier s ON l.l_suppkey=s.s_suppkey
 JOIN nation n ON s.s_nationkey=n.n_nationkey),
ledger_parsed AS (
 SELECT *, CAST(CASE WHEN amount_text LIKE '%-%' THEN -1 ELSE 1 END
   * CAST(replace(replace(amount_text, ',', ''), '-', '') AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS amount
 FROM ledger),
summary AS (
 SELECT company, func_area, gl_text, CAST(round(sum(amount), 2) AS DECIMAL(18,2)) AS amount
 FROM ledger_parsed WHERE func_area IN ('销售费用','管理费用','研发费用')
 GROUP BY company, func_area, gl_text)"""

SCOPE = """
scope AS (
 SELECT CAST(n_nationkey AS BIGINT) AS serial, n_name AS company, n_name AS report_name,
  concat('C', lpad(CAST(n_nationkey AS VARCHAR), 4, '0')) AS sap_code,
  CASE WHEN n_regionkey = 1 THEN '是' WHEN n_regionkey = 2 THEN NULL ELSE '否' END AS fx_flag,
  CAST(n_nationkey AS BIGINT) AS seq
 FROM (SELECT DISTINCT n.n_nationkey, n.n_name, n.n_regionkey
       FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey) e
 UNION ALL SELECT * FROM (VALUES (CAST(99 AS BIGINT), 'EXTRA', 'EXTRA', 'C9999', '否', CAST(99 AS BIGINT)),
  (100, 'NATION_3', 'NATION_3-NEW', 'C0003', '否', 100)) v(serial, company, report_name, sap_code, fx_flag, seq))"""

TEMPLATE = """
template AS (
 SELECT n.n_name AS file_name, CAST(c.c_custkey + 2 AS BIGINT) AS row_no,
  CASE c.c_custkey % 4 WHEN 0 THEN '销售费用' WHEN 1 THEN '管理费用' WHEN 2 THEN '研发费用' END AS a
 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
slots AS (
 SELECT file_name AS company,
  count(CASE WHEN a = '销售费用' THEN 1 END) - 2 AS slots_0,
  count(CASE WHEN a = '管理费用' THEN 1 END) - 2 AS slots_1,
  count(CASE WHEN a = '研发费用' THEN 1 END) - 2 AS slots_2
 FROM template GROUP BY file_name)"""

LED = with_(TB, LEDGER)

ORACLE["parse_thousands"] = LED + """
SELECT company, amount_text, CAST(TRY_CAST(replace(amount_text, ',', '') AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM ledger"""

ORACLE["parse_trailing_minus"] = LED + """
SELECT company, amount_text, CAST(amount AS DOUBLE) AS amount FROM ledger_parsed"""

ORACLE["semi_categories"] = LED + """
SELECT company, func_area, gl_text, CAST(amount AS DOUBLE) AS amount FROM ledger_parsed
WHERE func_area IN ('销售费用','管理费用','研发费用')"""

ORACLE["expense_summary"] = LED + """
SELECT company, func_area, gl_text, CAST(amount AS DOUBLE) AS amount FROM summary"""

ORACLE["expense_fx"] = with_(TB, LEDGER, SCOPE) + """
SELECT s.company, s.func_area, s.gl_text,
 CAST(s.amount * CASE WHEN f.fx THEN CAST(7.1140 AS DECIMAL(10,4)) ELSE CAST(1 AS DECIMAL(10,4)) END AS DOUBLE) AS amount
FROM summary s LEFT JOIN (SELECT company, bool_or(coalesce(fx_flag = '是', false)) AS fx FROM scope GROUP BY company) f
 ON s.company = f.company"""


def _placed(src: str, key: str, start_expr: str) -> str:
    return f"""
, lines AS (SELECT *, row_number() OVER (PARTITION BY {key}, func_area ORDER BY gl_text) AS line_no FROM {src})
, placed AS (SELECT *, {start_expr} + line_no - 1 AS row_no FROM lines)
SELECT {key}, '8_费用' AS sheet, concat('C', CAST(row_no AS VARCHAR)) AS cell, gl_text AS text, CAST(NULL AS DOUBLE) AS amount
FROM placed
UNION ALL
SELECT {key}, '8_费用', concat('E', CAST(row_no AS VARCHAR)), NULL, CAST(amount AS DOUBLE) FROM placed"""


_FIXED_START = "CASE func_area WHEN '销售费用' THEN 2 WHEN '管理费用' THEN 168 WHEN '研发费用' THEN 348 END"

ORACLE["place_fixed"] = LED[:-1] + _placed("summary", "company", _FIXED_START)

ORACLE["ledger_to_cells"] = with_(TB, LEDGER, SCOPE)[:-1] + """
, fxsum AS (
 SELECT s.company, s.func_area, s.gl_text,
  s.amount * CASE WHEN f.fx THEN CAST(7.1140 AS DECIMAL(10,4)) ELSE CAST(1 AS DECIMAL(10,4)) END AS amount
 FROM summary s LEFT JOIN (SELECT company, bool_or(coalesce(fx_flag = '是', false)) AS fx FROM scope GROUP BY company) f
  ON s.company = f.company)""" + _placed("fxsum", "company", _FIXED_START)

ORACLE["slot_counts"] = with_(TEMPLATE) + """
SELECT company, CAST(slots_0 AS BIGINT) AS slots_0, CAST(slots_1 AS BIGINT) AS slots_1, CAST(slots_2 AS BIGINT) AS slots_2
FROM slots"""

_DYN = """
, counts AS (
 SELECT company, count(CASE WHEN func_area='销售费用' THEN 1 END) AS n0,
  count(CASE WHEN func_area='管理费用' THEN 1 END) AS n1, count(CASE WHEN func_area='研发费用' THEN 1 END) AS n2
 FROM summary GROUP BY company)
, p AS (
 SELECT s.company, s.slots_0 AS s0, s.slots_1 AS s1, s.slots_2 AS s2, coalesce(c.n0, 0) AS n0, coalesce(c.n1, 0) AS n1, coalesce(c.n2, 0) AS n2,
  CASE WHEN c.company IS NULL THEN 0 ELSE greatest(c.n0 - s.slots_0, 0) END AS a0,
  CASE WHEN c.company IS NULL THEN 0 ELSE greatest(c.n1 - s.slots_1, 0) END AS a1,
  CASE WHEN c.company IS NULL THEN 0 ELSE greatest(c.n2 - s.slots_2, 0) END AS a2
 FROM slots s LEFT JOIN counts c ON c.company = s.company)
, plan AS (
 SELECT company, '销售费用' AS func_area, s0 AS slots, n0 AS lines, a0 AS rows_added, 2 AS start_row, s0 AS copy_row FROM p
 UNION ALL
 SELECT company, '管理费用', s1, n1, a1, 2 + s0 + 6 + a0, s0 + s1 + 6 + a0 FROM p
 UNION ALL
 SELECT company, '研发费用', s2, n2, a2, 2 + s0 + 6 + s1 + 6 + a0 + a1, s0 + s1 + 6 + s2 + 6 + a0 + a1 FROM p)
"""

ORACLE["place_dynamic_plan"] = with_(TB, LEDGER, TEMPLATE)[:-1] + _DYN + """
SELECT company, func_area, CAST(slots AS BIGINT) AS slots, CAST(lines AS BIGINT) AS lines,
 CAST(rows_added AS BIGINT) AS rows_added, CAST(start_row AS BIGINT) AS start_row, CAST(copy_row AS BIGINT) AS copy_row
FROM plan"""

ORACLE["place_dynamic"] = with_(TB, LEDGER, TEMPLATE)[:-1] + _DYN + """
, summ_start AS (SELECT s.*, p.start_row FROM summary s JOIN plan p ON s.company = p.company AND s.func_area = p.func_area)
""" + _placed("summ_start", "company", "start_row")

ORACLE["read_scope"] = with_(SCOPE) + "SELECT * REPLACE (seq + 2 AS seq) FROM scope"

ORACLE["read_ledger"] = LED + "SELECT company AS file_name, company_code, func_area, gl_text, amount_text FROM ledger"

ORACLE["ledger_rejects"] = LED + """
SELECT company, func_area, gl_text, concat(amount_text, 'x') AS amount_text, 'amount is no number' AS reason
FROM ledger WHERE func_area = '研发费用'"""

ORACLE["placement_rejects"] = with_(TB, LEDGER, TEMPLATE) + """
SELECT company, count(*) AS lines, 'no template sheet' AS reason FROM summary
WHERE company NOT IN (SELECT company FROM slots WHERE CAST(substring(company, 8) AS INT) % 2 = 1) GROUP BY company"""

ORACLE["lookup_report_name"] = with_(SCOPE) + """
SELECT sap_code, report_name FROM (
 SELECT *, row_number() OVER (PARTITION BY sap_code ORDER BY seq DESC) AS rn FROM scope) t WHERE rn = 1"""

ORACLE["fx_entity_filter"] = with_(SCOPE) + """
SELECT *, true AS is_fx FROM scope WHERE fx_flag IS NOT DISTINCT FROM '是'
UNION ALL
SELECT *, false FROM scope WHERE fx_flag IS DISTINCT FROM '是'"""

ORACLE["paper_name"] = with_(SCOPE) + """
SELECT sap_code, concat(CAST(serial AS VARCHAR), '-', company, '2024.xlsx') AS paper FROM scope"""

ORACLE["split_ledger"] = with_(TB, LEDGER, SCOPE)[:-1] + """
, names AS (SELECT sap_code, report_name FROM (
   SELECT *, row_number() OVER (PARTITION BY sap_code ORDER BY seq DESC) AS rn FROM scope) t WHERE rn = 1)
SELECT n.report_name, n.sap_code AS company_code, l.company, l.func_area, l.gl_text, l.amount_text
FROM names n LEFT JOIN ledger l ON n.sap_code = l.company_code"""

ORACLE["batch_entities"] = with_(TB, LEDGER, SCOPE)[:-1] + """
, by_code AS (
 SELECT company_code, func_area, gl_text, CAST(round(sum(amount), 2) AS DECIMAL(18,2)) AS amount
 FROM ledger_parsed WHERE func_area IN ('销售费用','管理费用','研发费用') GROUP BY 1, 2, 3)
, per_paper AS (
 SELECT concat(CAST(s.serial AS VARCHAR), '-', s.company, '2024.xlsx') AS paper, b.func_area, b.gl_text,
  b.amount * CASE WHEN s.fx_flag IS NOT DISTINCT FROM '是' THEN CAST(7.1140 AS DECIMAL(10,4)) ELSE CAST(1 AS DECIMAL(10,4)) END AS amount
 FROM by_code b JOIN scope s ON b.company_code = s.sap_code)""" + _placed("per_paper", "paper", _FIXED_START)

# ---------------------------------------------------------------------------
# Counterparty extraction (sheet columns by position, see fixtures).
# ---------------------------------------------------------------------------

CP_BASE = """
cp AS (
 SELECT CAST(c.c_nationkey AS VARCHAR) AS file_name, CAST(o.o_orderkey + 10 AS BIGINT) AS row_no,
  CASE WHEN o.o_orderkey % 59 = 0 THEN '供应商编码' WHEN o.o_orderkey % 97 = 0 THEN '合计'
       WHEN o.o_orderkey % 89 = 0 THEN NULL WHEN o.o_orderkey % 61 = 0 THEN '下方填写其他'
       ELSE concat('K', CAST(c.c_custkey AS VARCHAR)) END AS code_ap,
  CASE WHEN o.o_orderkey % 59 = 0 THEN '客户编码' WHEN o.o_orderkey % 97 = 0 THEN '合计'
       WHEN o.o_orderkey % 89 = 0 THEN NULL WHEN o.o_orderkey % 61 = 0 THEN '下方填写其他'
       ELSE concat('K', CAST(c.c_custkey AS VARCHAR)) END AS code_ar,
  c.c_name AS name,
  CASE WHEN o.o_orderkey % 101 = 0 THEN '款项性质' WHEN o.o_orderkey % 103 = 0 THEN '勾稽核对'
       WHEN o.o_orderkey % 89 = 0 THEN NULL ELSE o.o_orderpriority END AS nature,
  CASE WHEN o.o_orderkey % 83 = 0 THEN '币种' WHEN o.o_orderkey % 5 = 0 THEN 'USD'
       WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE 'CNY' END AS cur,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL WHEN o.o_orderkey % 13 = 0 THEN '0'
       ELSE CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amt,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(CAST(c.c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS a1,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE CAST(c.c_custkey AS VARCHAR) END AS a2,
  CASE WHEN o.o_orderkey % 23 = 0 THEN NULL WHEN o.o_orderkey % 29 = 0 THEN 'n/a' ELSE o.o_orderstatus END AS a3,
  CASE WHEN o.o_orderkey % 3 = 0 THEN '是' END AS flag
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

_N = "CAST(NULL AS VARCHAR)"


def _cols(names, values):
    return ", ".join(f'{v} AS "{n}"' for n, v in zip(names, values))


_OAR_NAMES = ["名称", "款项性质", "期初余额", "借方发生额", "贷方发生额", "期末余额", "单项坏账", "收到往来款", "支付往来款",
              "1年以内", "1-2年", "2-3年", "3-4年", "4-5年", "5年以上", "外币金额", "币种", "账龄核对", "外币核对"]
_OAR_VALS = ["name", "nature", "a1", "a2", "a3", "amt"] + [_N] * 10 + ["cur", _N, _N]
_OAP_NAMES = ["名称", "款项性质", "期初余额", "借方发生额", "贷方发生额", "期末余额", "收到往来款", "支付往来款",
              "1年以内", "1-2年", "2-3年", "3年以上", "外币金额", "币种", "账龄核对", "外币核对"]
_OAP_VALS = ["name", "nature", "a1", "a2", "a3", "amt"] + [_N] * 7 + ["cur", _N, _N]
_AP_NAMES = ["供应商编码", "供应商名称", "合并关联方（是/不填）", "非合并关联方（是/不填）", "款项性质", "期末余额_原币", "币种",
             "人民币金额", "1年以内", "1-2年", "2-3年", "3年以上", "余额合计核对", "外币金额核对",
             "余额由外币和人民币组成对，其中人民币金额"]
_AP_VALS = ["code_ap", "name", "flag", _N, "nature", "a1", "cur", "amt", "amt"] + [_N] * 6
_AR_NAMES = ["客户编码", "客户名称", "合并关联方（是/不填）", "非合并关联方（是/不填）", "期初余额_原币", "币种", "人民币金额",
             "1年以内", "1-2年", "2-3年", "3-4年", "4-5年", "5年以上", "是否单项认定计提坏账准备", "余额合计核对",
             "外币金额核对", "余额由外币和人民币组成对，其中人民币金额"]
_ADV_NAMES = ["客户编码", "客户名称", "合并关联方（是/不填）", "非合并关联方（是/不填）", "期初余额_原币", "币种", "人民币金额",
              "1年以内", "1-2年", "2-3年", "3年以上", "余额合计核对", "外币金额核对",
              "余额由外币和人民币组成对，其中人民币金额", "税率", "合同负债", "其他流动负债"]
_AR_VALS = ["code_ar", "name", "flag", _N, "a1", "cur", "amt", "amt"] + [_N] * 8 + ["a3"]

_CF2_KEEP = """NOT coalesce(nature IN ('款项性质','合计','勾稽核对'), false) AND nature IS NOT NULL
 AND (a1 IS NOT NULL OR a2 IS NOT NULL OR a3 IS NOT NULL) AND TRY_CAST(amt AS DOUBLE) IS DISTINCT FROM 0"""
_AP_KEEP = """NOT coalesce(code_ap IN ('供应商编码','合计','下方填写合并关联方','下方填写非合并关联方','下方填写其他'), false)
 AND NOT coalesce(cur IN ('币种'), false) AND amt IS NOT NULL AND TRY_CAST(amt AS DOUBLE) IS DISTINCT FROM 0"""
_AR_KEEP = """NOT coalesce(code_ar IN ('客户编码','合计','下方填写合并关联方','下方填写非合并关联方','下方填写其他'), false)
 AND NOT coalesce(cur IN ('币种'), false) AND amt IS NOT NULL AND TRY_CAST(amt AS DOUBLE) IS DISTINCT FROM 0"""

CP_TABLES = {
    "其他应收款": (_OAR_NAMES, _OAR_VALS, _CF2_KEEP),
    "其他应付款": (_OAP_NAMES, _OAP_VALS, _CF2_KEEP),
    "应付账款": (_AP_NAMES, _AP_VALS, _AP_KEEP),
    "预付账款": (_AP_NAMES, _AP_VALS, _AP_KEEP),
    "其他非流动资产": (_AP_NAMES, _AP_VALS, _AP_KEEP),
    "应收账款": (_AR_NAMES, _AR_VALS, _AR_KEEP),
    "预收账款": (_ADV_NAMES, _AR_VALS, _AR_KEEP),
}


def _cp_select(name):
    names, vals, keep = CP_TABLES[name]
    return f'SELECT file_name AS "文件名", row_no, {_cols(names, vals)} FROM cp WHERE {keep}'


for _k, _nm in [("counterparty_other_receivables", "其他应收款"), ("counterparty_other_payables", "其他应付款"),
                ("counterparty_payables", "应付账款"), ("counterparty_prepayments", "预付账款"),
                ("counterparty_other_noncurrent", "其他非流动资产"), ("counterparty_receivables", "应收账款"),
                ("counterparty_advances", "预收账款")]:
    ORACLE[_k] = with_(CP_BASE) + _cp_select(_nm)

ORACLE["counterparty_extract"] = with_(CP_BASE) + "\nUNION ALL\n".join(
    f"SELECT '{nm}' AS \"table\", file_name, row_no, concat_ws('|', {', '.join(v for v in CP_TABLES[nm][1])}) AS \"values\" "
    f"FROM cp WHERE {CP_TABLES[nm][2]}" for nm in CP_TABLES)

ORACLE["project_positional"] = with_(CP_BASE) + "SELECT file_name, row_no, " + ", ".join(
    f"{v} AS c{i}" for i, v in zip(range(11, 30), _OAR_VALS)) + " FROM cp"

ORACLE["rename_positional"] = with_(CP_BASE) + f'SELECT file_name AS "文件名", row_no, {_cols(_AP_NAMES, _AP_VALS)} FROM cp'

ORACLE["drop_marker_rows"] = with_(CP_BASE) + f"""SELECT file_name AS "文件名", row_no, {_cols(_AP_NAMES, _AP_VALS)} FROM cp
WHERE NOT coalesce(code_ap IN ('供应商编码','合计','下方填写合并关联方','下方填写非合并关联方','下方填写其他'), false)
 AND NOT coalesce(cur IN ('币种'), false)"""

ORACLE["require_any"] = with_(CP_BASE) + """SELECT file_name, row_no, name AS c11, nature AS c12, a1 AS c13, a2 AS c14,
 a3 AS c15, amt AS c16 FROM cp WHERE nature IS NOT NULL AND (a1 IS NOT NULL OR a2 IS NOT NULL OR a3 IS NOT NULL)"""

ORACLE["nonzero"] = with_(CP_BASE) + """
SELECT 'keep_null' AS mode, file_name, row_no, amt AS amount_text FROM cp WHERE TRY_CAST(amt AS DOUBLE) IS DISTINCT FROM 0
UNION ALL
SELECT 'not_null', file_name, row_no, amt FROM cp WHERE amt IS NOT NULL AND TRY_CAST(amt AS DOUBLE) IS DISTINCT FROM 0"""

# ---------------------------------------------------------------------------
# Statements (template lines x supplier totals).
# ---------------------------------------------------------------------------


def _coef_sql(c):
    return "NULL, NULL, NULL" if c is None else ", ".join(str(x) for x in c)


def _q(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _stmt_ctes():
    from tallyspark.plans.fixtures import BALANCE_TEMPLATE, INCOME_TEMPLATE
    bt = ",\n  ".join(f"({r}, {_q(a)}, {_coef_sql(ac)}, {_q(lb)}, {_coef_sql(lc)})"
                      for r, a, ac, lb, lc in BALANCE_TEMPLATE)
    it = ",\n  ".join(f"({r}, {_q(i)}, {_coef_sql(c)})" for r, i, c in INCOME_TEMPLATE)
    amt = ("CASE WHEN {p}1 IS NULL THEN NULL ELSE CAST(round(round(sales * CAST({p}1 AS DECIMAL(10,4)) + ret * CAST({p}2 AS DECIMAL(10,4))"
           " + qty * CAST({p}3 AS DECIMAL(10,4)), 2) * CAST({s} AS DECIMAL(10,4)), 2) AS DECIMAL(18,2)) END")
    return f"""
st AS (
 SELECT s.s_name AS file_name,
  CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS sales,
  CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS ret,
  CAST(sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS qty
 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, s.s_name),
bt AS (SELECT * FROM (VALUES
  {bt}) v(r, asset, a1, a2, a3, liab, b1, b2, b3)),
it AS (SELECT * FROM (VALUES
  {it}) v(r, item, c1, c2, c3)),
bal_lines AS (
 SELECT st.file_name, CAST(4 + bt.r AS BIGINT) AS row_no, bt.asset, {amt.format(p='a', s='1')} AS asset_close,
  {amt.format(p='a', s='0.9')} AS asset_open, bt.liab, {amt.format(p='b', s='1')} AS liab_close,
  {amt.format(p='b', s='0.9')} AS liab_open
 FROM st CROSS JOIN bt),
inc_lines AS (
 SELECT st.file_name, CAST(4 + it.r AS BIGINT) AS row_no, CAST(it.r - 1 AS BIGINT) AS line_idx, it.item,
  {amt.format(p='c', s='1')} AS cur, {amt.format(p='c', s='1.1')} AS ytd,
  {amt.format(p='c', s='0.8')} AS prior, {amt.format(p='c', s='0.7')} AS prior_ytd
 FROM st CROSS JOIN it),
panels AS (SELECT * FROM bal_lines WHERE asset IS NOT NULL AND NOT coalesce(contains(asset, '制表人'), false)),
income AS (SELECT * FROM inc_lines WHERE item IS NOT NULL AND NOT coalesce(contains(item, '制表人'), false)),
stacked AS (
 SELECT file_name, row_no, 'assets' AS panel, trim(coalesce(asset, '')) AS item, asset_close AS close, asset_open AS open FROM panels
 UNION ALL
 SELECT file_name, row_no, 'liab', trim(coalesce(liab, '')), liab_close, liab_open FROM panels),
markers AS (
 SELECT file_name,
  min(CASE WHEN panel = 'assets' AND contains(item, '流动资产合计') THEN row_no END) AS m_ca,
  min(CASE WHEN panel = 'assets' AND contains(item, '非流动资产合计') THEN row_no END) AS m_nca,
  min(CASE WHEN panel = 'liab' AND contains(item, '流动负债合计') THEN row_no END) AS m_cl,
  min(CASE WHEN panel = 'liab' AND contains(item, '非流动负债:') THEN row_no END) AS m_ncl0,
  min(CASE WHEN panel = 'liab' AND contains(item, '非流动负债合计') THEN row_no END) AS m_ncl,
  min(CASE WHEN panel = 'liab' AND contains(item, '所有者权益（或股东权益）') THEN row_no END) AS m_eq0,
  min(CASE WHEN panel = 'liab' AND contains(item, '所有者权益（或股东权益）合计') THEN row_no END) AS m_eq
 FROM stacked GROUP BY file_name),
sectioned AS (
 SELECT s.file_name, s.row_no, s.panel, s.item, s.close, s.open,
  CASE WHEN s.panel = 'assets' AND s.row_no < m.m_ca THEN '流动资产'
       WHEN s.panel = 'assets' AND s.row_no > m.m_ca AND s.row_no < m.m_nca THEN '非流动资产'
       WHEN s.panel = 'liab' AND s.row_no < m.m_cl THEN '流动负债'
       WHEN s.panel = 'liab' AND s.row_no >= m.m_ncl0 AND s.row_no < m.m_ncl THEN '非流动负债'
       WHEN s.panel = 'liab' AND s.row_no >= m.m_eq0 AND s.row_no < m.m_eq THEN '所有者权益' END AS category
 FROM stacked s JOIN markers m ON s.file_name = m.file_name),
lines AS (
 SELECT file_name, row_no, panel, item, close, open, category, concat(item, '_', category) AS line_key
 FROM sectioned WHERE category IS NOT NULL
 UNION ALL
 SELECT file_name, row_no, panel, item, close, open, '合计', concat(item, '_合计') FROM stacked WHERE contains(item, '合计')),
bal_long AS (
 SELECT file_name, row_no, item, category, line_key, '期末余额' AS amount_type, close AS amount FROM lines
 UNION ALL
 SELECT file_name, row_no, item, category, line_key, '期初余额', open FROM lines),
inc_long AS (
 SELECT file_name, row_no, trim(item) AS item, '损益' AS category, concat(CAST(line_idx AS VARCHAR), '_', trim(item)) AS line_key,
  t.amount_type, t.amount
 FROM income CROSS JOIN LATERAL (VALUES ('本期金额', cur), ('本年金额', ytd), ('上年金额', prior), ('上年同期金额', prior_ytd)) t(amount_type, amount)),
stmt_long AS (
 SELECT item, category, amount_type, amount, line_key, file_name, row_no, '资产负债表' AS statement FROM bal_long
 UNION ALL
 SELECT item, category, amount_type, amount, line_key, file_name, row_no, '利润表' FROM inc_long)"""


def _stmt_rules_cte():
    from tallyspark.plans.fixtures import STATEMENT_RULES
    vals = ",\n  ".join("(" + ", ".join(_q(x) for x in r) + ")" for r in STATEMENT_RULES)
    return f"""
rules AS (SELECT * FROM (VALUES
  {vals}) v(sheet, cell, accts, ops, items))"""


STMT = with_(_stmt_ctes())

ORACLE["read_statement_ranges"] = STMT + """
SELECT file_name, row_no, asset, CAST(asset_close AS VARCHAR) AS asset_close, CAST(asset_open AS VARCHAR) AS asset_open,
 liab, CAST(liab_close AS VARCHAR) AS liab_close, CAST(liab_open AS VARCHAR) AS liab_open FROM panels"""

ORACLE["drop_contains"] = STMT + """
SELECT file_name, row_no, line_idx, item, CAST(cur AS VARCHAR) AS cur, CAST(ytd AS VARCHAR) AS ytd,
 CAST(prior AS VARCHAR) AS prior, CAST(prior_ytd AS VARCHAR) AS prior_ytd FROM income"""

ORACLE["stack_panels"] = STMT + """
SELECT file_name, row_no, panel, item, CAST(close AS DOUBLE) AS close, CAST(open AS DOUBLE) AS open FROM stacked"""

ORACLE["strip_text"] = STMT + "SELECT file_name, row_no, panel, item FROM stacked"

ORACLE["section_lines"] = STMT + """
SELECT file_name, row_no, panel, item, CAST(close AS DOUBLE) AS close, CAST(open AS DOUBLE) AS open, category, line_key
FROM lines"""

ORACLE["melt_balance_sheet"] = STMT + """
SELECT file_name, row_no, item, category, line_key, CAST(amount AS DOUBLE) AS amount, amount_type FROM bal_long"""

ORACLE["melt_income"] = STMT + """
SELECT file_name, row_no, item, category, line_key, CAST(amount AS DOUBLE) AS amount, amount_type FROM inc_long"""

ORACLE["concat_statements"] = STMT + """
SELECT item, category, amount_type, CAST(amount AS DOUBLE) AS amount, line_key, file_name, row_no, statement FROM stmt_long"""

ORACLE["line_keys"] = STMT + "SELECT DISTINCT file_name, statement, line_key FROM stmt_long"

ORACLE["tag_literals"] = STMT + "SELECT DISTINCT file_name, row_no, line_key, category, statement FROM stmt_long"

_STMT_CELLS = with_(_stmt_ctes(), _stmt_rules_cte(), PARTS_RAW, PARTS_SIGNED)[:-1] + """
, files AS (SELECT DISTINCT file_name FROM stmt_long)
, per_file AS (SELECT f.file_name, p.* FROM files f CROSS JOIN (SELECT * FROM parts_signed WHERE sheet = '原报表') p)
SELECT a.file_name, a.sheet, a.cell, CAST(coalesce(round(sum(b.amount * a.sign), 2), 0) AS DOUBLE) AS amount
FROM per_file a LEFT JOIN stmt_long b
 ON a.file_name = b.file_name AND a.acct_code = b.line_key AND a.item = b.amount_type
GROUP BY a.file_name, a.sheet, a.cell"""

ORACLE["statement_cells"] = _STMT_CELLS
ORACLE["statements_to_cells"] = _STMT_CELLS

# ---------------------------------------------------------------------------
# Working papers (expense sheets filled from the ledger summary).
# ---------------------------------------------------------------------------

PAPERS = """
plines AS (
 SELECT s.*, row_number() OVER (PARTITION BY s.company, s.func_area ORDER BY s.gl_text) AS rn,
  CASE WHEN n.n_regionkey = 4 THEN concat(n.n_name, '公司小合并2024') WHEN n.n_regionkey = 3 THEN concat(n.n_name, '公司日志')
       ELSE concat(n.n_name, '公司2024') END AS file_name
 FROM summary s JOIN nation n ON s.company = n.n_name),
exp_rows AS (
 SELECT CASE WHEN rn > 60 THEN concat(file_name, '_', CAST((rn - 1) // 60 AS VARCHAR)) ELSE file_name END AS file_name,
  CAST(CASE func_area WHEN '销售费用' THEN 2 WHEN '管理费用' THEN 68 ELSE 138 END + (rn - 1) % 60 AS BIGINT) AS row_no,
  func_area AS a, concat('66', lpad(CAST(rn AS VARCHAR), 2, '0')) AS b, gl_text AS c, func_area AS d,
  CASE WHEN rn % 7 = 0 THEN NULL ELSE CAST(amount AS VARCHAR) END AS e, CAST(NULL AS VARCHAR) AS f, '0.00' AS g
 FROM plines),
yoy_rows AS (
 SELECT CASE WHEN rn > 30 THEN concat(file_name, '_', CAST((rn - 1) // 30 AS VARCHAR)) ELSE file_name END AS file_name,
  CAST(CASE func_area WHEN '销售费用' THEN 94 WHEN '管理费用' THEN 127 ELSE 160 END + (rn - 1) % 30 AS BIGINT) AS row_no,
  gl_text AS a, CAST(amount AS VARCHAR) AS b,
  CAST(CAST(round(amount * CAST(0.9 AS DECIMAL(10,4)), 2) AS DECIMAL(18,2)) AS VARCHAR) AS c
 FROM plines),
pfiles AS (SELECT DISTINCT file_name FROM plines),
allfiles AS (SELECT file_name FROM exp_rows UNION SELECT file_name FROM yoy_rows),
paper_cells AS (
 SELECT file_name, '8_费用' AS sheet, row_no, CAST(t.col_no AS BIGINT) AS col_no, t.value
 FROM exp_rows CROSS JOIN LATERAL (VALUES (0, a), (1, b), (2, c), (3, d), (4, e), (5, f), (6, g)) t(col_no, value)
 WHERE t.value IS NOT NULL
 UNION ALL
 SELECT file_name, '8', row_no, CAST(t.col_no AS BIGINT), t.value
 FROM yoy_rows CROSS JOIN LATERAL (VALUES (0, a), (1, b), (2, c)) t(col_no, value)
 WHERE t.value IS NOT NULL
 UNION ALL
 SELECT f.file_name, '8_费用', CAST(h.r AS BIGINT), CAST(t.col_no AS BIGINT), t.value
 FROM allfiles f CROSS JOIN (VALUES (1), (67), (137)) h(r)
 CROSS JOIN (VALUES (0, '类别'), (1, '科目编码'), (2, '底稿科目'), (3, '附注分类'), (4, '本期未审'), (5, '重分类调整'),
  (6, '审计调整')) t(col_no, value)
 UNION ALL
 SELECT f.file_name, '8', CAST(h.r AS BIGINT), CAST(t.col_no AS BIGINT), t.value
 FROM allfiles f CROSS JOIN (VALUES (93), (126), (159)) h(r)
 CROSS JOIN (VALUES (0, '项目'), (1, '本期发生额'), (2, '上期发生额')) t(col_no, value)),
good_files AS (
 SELECT file_name FROM allfiles
 WHERE contains(file_name, '公司') AND NOT contains(file_name, '日志') AND NOT contains(file_name, '~$')
   AND NOT contains(file_name, '小合并'))"""

PAP = with_(TB, LEDGER, PAPERS)

ORACLE["filter_files"] = PAP + "SELECT file_name FROM good_files"

_EXP_COLS = """b AS "科目编码", c AS "底稿科目", d AS "附注分类", e AS "本期未审", f AS "重分类调整", g AS "审计调整\""""

ORACLE["read_range"] = PAP + f"""
SELECT file_name AS "文件名", row_no, {_EXP_COLS}
FROM exp_rows WHERE file_name IN (SELECT file_name FROM good_files) AND row_no BETWEEN 2 AND 61"""

_AUDITED = f"""
, audited AS (
 SELECT file_name AS "公司", row_no, {_EXP_COLS},
  CASE WHEN row_no BETWEEN 2 AND 61 THEN '审定表_销售费用' WHEN row_no BETWEEN 68 AND 131 THEN '审定表_管理费用'
       WHEN row_no BETWEEN 138 AND 201 THEN '审定表_研发费用' END AS "table"
 FROM exp_rows
 WHERE file_name IN (SELECT file_name FROM good_files) AND e IS NOT NULL
   AND (row_no BETWEEN 2 AND 61 OR row_no BETWEEN 68 AND 131 OR row_no BETWEEN 138 AND 201))
"""

ORACLE["expense_papers_audited"] = PAP[:-1] + _AUDITED + "SELECT * FROM audited"

ORACLE["expense_papers_yoy"] = PAP + """
SELECT file_name AS "公司", row_no, a AS "项目", b AS "本期发生额", c AS "上期发生额",
 CASE WHEN row_no BETWEEN 94 AND 123 THEN '同期比较_销售费用' WHEN row_no BETWEEN 127 AND 156 THEN '同期比较_管理费用'
      ELSE '同期比较_研发费用' END AS "table"
FROM yoy_rows WHERE file_name IN (SELECT file_name FROM good_files)
 AND (row_no BETWEEN 94 AND 123 OR row_no BETWEEN 127 AND 156 OR row_no BETWEEN 160 AND 189)"""

ORACLE["range_export"] = PAP + """
SELECT file_name AS "文件名", row_no, a AS "项目", b AS "本期发生额", c AS "上期发生额"
FROM yoy_rows WHERE NOT contains(file_name, '合并') AND NOT contains(file_name, '日志') AND NOT contains(file_name, '~$')
 AND row_no BETWEEN 94 AND 123"""

ORACLE["stack_by_name"] = PAP + f"""
SELECT file_name AS "文件名", row_no, {_EXP_COLS}, CAST(NULL AS VARCHAR) AS "项目", CAST(NULL AS VARCHAR) AS "本期发生额",
 CAST(NULL AS VARCHAR) AS "上期发生额"
FROM exp_rows WHERE file_name IN (SELECT file_name FROM good_files) AND row_no BETWEEN 2 AND 61
UNION ALL
SELECT file_name, row_no, NULL, NULL, NULL, NULL, NULL, NULL, a, b, c
FROM yoy_rows WHERE file_name IN (SELECT file_name FROM good_files) AND row_no BETWEEN 94 AND 123"""

_TEMPLATE_VALUES = """(VALUES (1, 0, '审定表'), (2, 0, '被审计单位'), (8, 0, '公司'), (8, 1, '科目编码'), (8, 2, '底稿科目'),
  (8, 3, '附注分类'), (8, 4, '本期未审'), (8, 5, '重分类调整'), (8, 6, '审计调整'), (10, 0, '样式行'), (11, 0, '合计'),
  (12, 0, '编制人')) v(row_no, col_no, value)"""


_YOY_TEMPLATE_VALUES = """(VALUES (1, 0, '同期比较'), (8, 0, '公司'), (8, 1, '项目'), (8, 2, '本期发生额'), (8, 4, '上期发生额'),
  (10, 0, '样式行'), (11, 0, '合计')) v(row_no, col_no, value)"""

_YOY = """
, yoy AS (
 SELECT file_name AS "公司", row_no, a AS "项目", b AS "本期发生额", c AS "上期发生额",
  CASE WHEN row_no BETWEEN 94 AND 123 THEN '同期比较_销售费用' WHEN row_no BETWEEN 127 AND 156 THEN '同期比较_管理费用'
       ELSE '同期比较_研发费用' END AS "table"
 FROM yoy_rows WHERE file_name IN (SELECT file_name FROM good_files)
  AND (row_no BETWEEN 94 AND 123 OR row_no BETWEEN 127 AND 156 OR row_no BETWEEN 160 AND 189))
"""


def _appended(table: str, src: str = "audited", template: str = None, cols: str = None,
              title: str | None = None) -> str:
    template = template or _TEMPLATE_VALUES
    if title is not None:
        template = f"""(SELECT row_no, col_no, CASE WHEN row_no = 1 AND col_no = 0 THEN '{title}' ELSE value END AS value
  FROM {template}) v"""
    cols = cols or """(0, "公司"), (1, "科目编码"), (2, "底稿科目"), (3, "附注分类"), (4, "本期未审"),
  (5, "重分类调整"), (6, "审计调整")"""
    return f"""
SELECT '{table}' AS sheet, row_no, col_no, value FROM (
 SELECT CAST(CASE WHEN v.row_no >= 10 THEN v.row_no + (SELECT count(*) FROM {src} WHERE "table" = '{table}') ELSE v.row_no END AS BIGINT) AS row_no,
  CAST(v.col_no AS BIGINT) AS col_no, v.value
 FROM {template}
 WHERE NOT EXISTS (SELECT 1 FROM {src} WHERE "table" = '{table}' AND v.row_no = 9)
 UNION ALL
 SELECT CAST(9 + p.pos AS BIGINT), CAST(t.col_off AS BIGINT), t.value
 FROM (SELECT *, row_number() OVER (ORDER BY "公司", row_no) - 1 AS pos FROM {src} WHERE "table" = '{table}') p
 CROSS JOIN LATERAL (VALUES {cols}) t(col_off, value)) x"""


_YOY_COLS = """(0, "公司"), (1, "项目"), (2, "本期发生额"), (4, "上期发生额")"""

ORACLE["append_block"] = PAP[:-1] + _AUDITED + _appended("审定表_销售费用")
_TITLES = {"审定表_销售费用": "销售费用审定表", "审定表_管理费用": "管理费用审定表", "审定表_研发费用": "研发费用审定表",
           "同期比较_销售费用": "销售费用本期与上年同期比较表", "同期比较_管理费用": "管理费用本期与上年同期比较表",
           "同期比较_研发费用": "研发费用本期与上年同期比较表"}

ORACLE["expense_papers"] = PAP[:-1] + _AUDITED + _YOY + "\nUNION ALL\n".join(
    [_appended(t, title=_TITLES[t]) for t in ["审定表_销售费用", "审定表_管理费用", "审定表_研发费用"]]
    + [_appended(t, "yoy", _YOY_TEMPLATE_VALUES, _YOY_COLS, title=_TITLES[t])
       for t in ["同期比较_销售费用", "同期比较_管理费用", "同期比较_研发费用"]])

ORACLE["apply_cell_updates"] = PAP[:-1] + """
, placed AS (
 SELECT file_name, '8_费用' AS sheet, CASE func_area WHEN '销售费用' THEN 2 WHEN '管理费用' THEN 168 ELSE 348 END + rn - 1 AS row_no,
  gl_text AS text, CAST(amount AS VARCHAR) AS amount_text FROM plines)
, updates AS (
 SELECT file_name, sheet, CAST(row_no AS BIGINT) AS row_no, CAST(2 AS BIGINT) AS col_no, text AS value, 1 AS seq FROM placed
 UNION ALL
 SELECT file_name, sheet, CAST(row_no AS BIGINT), CAST(4 AS BIGINT), amount_text, 1 FROM placed
 UNION ALL
 SELECT file_name, '8_费用', CAST(2 AS BIGINT), CAST(2 AS BIGINT), '改写', 2 FROM pfiles
 UNION ALL
 SELECT file_name, '8_费用', CAST(3 AS BIGINT), CAST(6 AS BIGINT), NULL, 2 FROM pfiles)
, latest AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_name, sheet, row_no, col_no ORDER BY seq DESC) AS k
  FROM updates) t WHERE k = 1)
SELECT coalesce(e.file_name, u.file_name) AS file_name, coalesce(e.sheet, u.sheet) AS sheet,
 coalesce(e.row_no, u.row_no) AS row_no, coalesce(e.col_no, u.col_no) AS col_no,
 CASE WHEN u.file_name IS NOT NULL THEN u.value ELSE e.value END AS value
FROM paper_cells e FULL OUTER JOIN latest u
 ON e.file_name = u.file_name AND e.sheet = u.sheet AND e.row_no = u.row_no AND e.col_no = u.col_no"""

_WRITE = """
, written AS (
 SELECT paper AS file_name, sheet, CAST(regexp_extract(cell, '([0-9]+)$', 1) AS BIGINT) AS row_no,
  CAST(ascii(cell) - 65 AS BIGINT) AS col_no, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS value FROM filled)
SELECT coalesce(e.file_name, u.file_name) AS file_name, coalesce(e.sheet, u.sheet) AS sheet,
 coalesce(e.row_no, u.row_no) AS row_no, coalesce(e.col_no, u.col_no) AS col_no,
 CASE WHEN u.file_name IS NOT NULL THEN u.value ELSE e.value END AS value
FROM paper_cells e FULL OUTER JOIN written u
 ON e.file_name = u.file_name AND e.sheet = u.sheet AND e.row_no = u.row_no AND e.col_no = u.col_no"""

ORACLE["tb_to_papers"] = PAP[:-1] + """
, filled AS (SELECT c.sheet, c.cell, c.amount, CASE WHEN n.n_regionkey = 4 THEN concat(n.n_name, '公司小合并2024')
   WHEN n.n_regionkey = 3 THEN concat(n.n_name, '公司日志') ELSE concat(n.n_name, '公司2024') END AS paper
 FROM (""" + ORACLE["tb_to_cells"] + """) c JOIN nation n ON n.n_name = c.company)""" + _WRITE

# Opening rules are dropped; a cell all of whose parts went is not written.
ORACLE["statements_to_papers"] = PAP[:-1] + """
, filled AS (SELECT sheet, cell, amount, concat(file_name, '公司2024') AS paper FROM (""" + _STMT_CELLS.replace(
    "WHERE sheet = '原报表') p)", "WHERE sheet = '原报表' AND NOT coalesce(contains(item, '期初余额'), false)) p)") + "))" + _WRITE

_BLOCK = """
, rect AS (
 SELECT CAST(r AS BIGINT) AS row_no, CAST(c AS BIGINT) AS col_no
 FROM (SELECT unnest(generate_series(2, 58)) AS r UNION ALL SELECT unnest(generate_series(68, 113))) rr
 CROSS JOIN (SELECT unnest(generate_series(1, 3)) AS c) cc)
, block AS (
 SELECT r.row_no, r.col_no, CASE WHEN p.value IS NOT NULL THEN concat('''', p.value) END AS value
 FROM rect r LEFT JOIN (SELECT * FROM paper_cells WHERE file_name = 'NATION_0公司2024' AND sheet = '8_费用') p
  ON r.row_no = p.row_no AND r.col_no = p.col_no)
"""

ORACLE["as_text_label"] = PAP[:-1] + _BLOCK + "SELECT '8_费用' AS sheet, row_no, col_no, value FROM block"

# The papers' cells once, and the block per paper; cells outside the block stay, those inside are the block's.
ORACLE["overlay_block"] = (PAP[:-1].replace("paper_cells AS (", "paper_cells AS MATERIALIZED (", 1).replace("plines AS (", "plines AS MATERIALIZED (", 1)
                           + _BLOCK.replace("block AS (", "block AS MATERIALIZED (", 1) + """
, spots AS (SELECT row_no, col_no FROM block)
SELECT e.file_name, e.sheet, e.row_no, e.col_no, e.value FROM paper_cells e
LEFT JOIN spots p ON p.row_no = e.row_no AND p.col_no = e.col_no
LEFT JOIN good_files g ON g.file_name = e.file_name
WHERE e.sheet <> '8_费用' OR p.row_no IS NULL OR g.file_name IS NULL
UNION ALL
SELECT g.file_name, '8_费用', b.row_no, b.col_no, b.value
FROM (SELECT DISTINCT file_name, '8_费用' AS sheet FROM good_files) g JOIN (SELECT *, '8_费用' AS sheet FROM block) b ON b.sheet = g.sheet""")

# Layout-A export rows read back generically.
ROWS_A_CELLS = """
a_cells AS (
 UNPIVOT (SELECT company AS file_name, acct_code AS "账户代码", acct_name AS "账户名称", open_dir AS "期初余额_方向",
   CAST(opening AS VARCHAR) AS "期初余额_金额", CAST(open_debit AS VARCHAR) AS "期初余额_借方金额",
   CAST(open_credit AS VARCHAR) AS "期初余额_贷方金额", CAST(period_debit AS VARCHAR) AS "期间发生额_借方金额",
   CAST(period_credit AS VARCHAR) AS "期间发生额_贷方金额", CAST(ytd_debit AS VARCHAR) AS "累计发生额_借方金额",
   CAST(ytd_credit AS VARCHAR) AS "累计发生额_贷方金额", close_dir AS "期末余额_方向", CAST(closing AS VARCHAR) AS "期末余额_金额",
   CAST(close_debit AS VARCHAR) AS "期末余额_借方金额", CAST(close_credit AS VARCHAR) AS "期末余额_贷方金额",
   CAST(5 + ((CASE left(acct_code,1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '4' THEN 2 WHEN '5' THEN 3 ELSE 4 END) * 5
          + CAST(substr(acct_code, 4, 1) AS INT) - 1) * 5
          + CASE WHEN length(acct_code) = 6 THEN CAST(substr(acct_code, 6, 1) AS INT) ELSE 0 END AS BIGINT) AS row_no
  FROM bal_a)
 ON "账户代码", "账户名称", "期初余额_方向", "期初余额_金额", "期初余额_借方金额", "期初余额_贷方金额", "期间发生额_借方金额",
    "期间发生额_贷方金额", "累计发生额_借方金额", "累计发生额_贷方金额", "期末余额_方向", "期末余额_金额", "期末余额_借方金额",
    "期末余额_贷方金额"
 INTO NAME col_name VALUE value)"""

ORACLE["auto_header"] = with_(TB, BAL_A, ROWS_A_CELLS) + """
SELECT file_name, 'Sheet1' AS sheet, row_no, col_name, value FROM a_cells
UNION ALL
SELECT DISTINCT company, 'Sheet1', CAST(300 AS BIGINT), '账户代码', '合计' FROM tb
UNION ALL
SELECT 'MULTI', 'Sheet1', CAST(5 AS BIGINT), 'x', '1001'
UNION ALL
SELECT 'MULTI', 'Sheet1', CAST(5 AS BIGINT), NULL, 'y'"""

ORACLE["read_used_range"] = with_(TB) + """
SELECT DISTINCT company AS file_name, 'Sheet1' AS sheet, CAST(1 AS BIGINT) AS first_row, CAST(300 AS BIGINT) AS last_row,
 CAST(14 AS BIGINT) AS n_cols FROM tb
UNION ALL SELECT 'MULTI', 'Sheet1', 1, 5, 2
UNION ALL SELECT 'MULTI', 'Sheet2', 1, 1, 1"""

ORACLE["scan_many"] = with_(TB, BAL_A) + """
SELECT company, acct_code, acct_name, open_dir, CAST(opening AS DOUBLE) AS opening,
 CAST(open_debit AS DOUBLE) AS open_debit, CAST(open_credit AS DOUBLE) AS open_credit,
 CAST(period_debit AS DOUBLE) AS period_debit, CAST(period_credit AS DOUBLE) AS period_credit,
 CAST(ytd_debit AS DOUBLE) AS ytd_debit, CAST(ytd_credit AS DOUBLE) AS ytd_credit, close_dir,
 CAST(closing AS DOUBLE) AS closing, CAST(close_debit AS DOUBLE) AS close_debit, CAST(close_credit AS DOUBLE) AS close_credit,
 company AS file_path
FROM bal_a"""

# ---------------------------------------------------------------------------
# Group workbook splits and statement placement.
# ---------------------------------------------------------------------------

_GROUP = """
, gbal AS (
 SELECT file_name AS company, asset AS "项目", CAST(row_no - 4 AS BIGINT) AS "行次", asset_close AS "期末余额",
  asset_open AS "年初余额", liab AS "项目_2", CAST(row_no - 4 AS BIGINT) AS "行次_2", liab_close AS "期末余额_2",
  liab_open AS "年初余额_2" FROM bal_lines)
, ginc AS (
 SELECT file_name AS company, item AS "项目", CAST(row_no - 4 AS BIGINT) AS "行次", cur AS "本期发生额",
  ytd AS "本年累计发生额" FROM inc_lines)
"""

ORACLE["split_statements"] = STMT[:-1] + _GROUP + """
SELECT company, "项目", "行次", CAST("期末余额" AS DOUBLE) AS "期末余额", CAST("年初余额" AS DOUBLE) AS "年初余额",
 "项目_2", "行次_2", CAST("期末余额_2" AS DOUBLE) AS "期末余额_2", CAST("年初余额_2" AS DOUBLE) AS "年初余额_2" FROM gbal"""

ORACLE["split_statements_income"] = STMT[:-1] + _GROUP + """
SELECT company, "项目", "行次", CAST("本期发生额" AS DOUBLE) AS "本期发生额", CAST("本年累计发生额" AS DOUBLE) AS "本年累计发生额"
FROM ginc"""

_PLACE = """
, placed_stmt AS (
 SELECT company, '原报表' AS sheet, concat('N', CAST(7 + row_number() OVER (PARTITION BY company ORDER BY "行次") AS VARCHAR)) AS cell,
  "期末余额" AS amount FROM gbal
 UNION ALL
 SELECT company, '原报表', concat('P', CAST(7 + row_number() OVER (PARTITION BY company ORDER BY "行次") AS VARCHAR)),
  "期末余额_2" FROM gbal
 UNION ALL
 SELECT company, '原报表', concat('N', CAST(83 + k AS VARCHAR)), amount FROM (
  SELECT company, row_number() OVER (PARTITION BY company ORDER BY "行次") AS k, "本年累计发生额" AS amount FROM ginc) t
 WHERE k <= 27)
"""

ORACLE["place_statement"] = STMT[:-1] + _GROUP + _PLACE + """
SELECT company, sheet, cell, CAST(amount AS DOUBLE) AS amount FROM placed_stmt"""
ORACLE["report_to_cells"] = ORACLE["place_statement"]

ORACLE["split_balances"] = with_(TB, BAL_B) + _B_OUT + " FROM bal_b"

ORACLE["split_group"] = with_(_stmt_ctes(), TB, BAL_B, LEDGER, SCOPE)[:-1] + _GROUP + """
, names AS (SELECT sap_code, report_name FROM (
   SELECT *, row_number() OVER (PARTITION BY sap_code ORDER BY seq DESC) AS rn FROM scope) t WHERE rn = 1)
SELECT company, count(*) AS count, 'statements' AS output FROM gbal GROUP BY company
UNION ALL SELECT company, count(*), 'income' FROM ginc GROUP BY company
UNION ALL SELECT n.report_name, count(l.gl_text), 'ledger' FROM names n LEFT JOIN ledger l ON n.sap_code = l.company_code
 GROUP BY n.report_name
UNION ALL SELECT company, count(*), 'balances' FROM bal_b GROUP BY company"""

ORACLE["join_rules_statements"] = with_(_stmt_ctes(), _stmt_rules_cte(), PARTS_RAW, PARTS_SIGNED)[:-1] + """
, files AS (SELECT DISTINCT file_name FROM stmt_long)
, per_file AS (SELECT f.file_name, p.* FROM files f CROSS JOIN parts_signed p)
SELECT a.file_name, a.acct_code, a.item, a.sheet, a.cell, CAST(a.part_no AS BIGINT) AS part_no, CAST(a.sign AS BIGINT) AS sign,
 CAST(b.amount AS DOUBLE) AS amount
FROM per_file a LEFT JOIN stmt_long b ON a.file_name = b.file_name AND a.acct_code = b.line_key AND a.item = b.amount_type"""

ORACLE["pair_files"] = with_(SCOPE) + """
SELECT concat(CAST(s.serial AS VARCHAR), '-', s.company, '2024.xlsx') AS paper, c.company, c.sheet, c.cell, c.amount
FROM scope s JOIN (""" + ORACLE["tb_to_cells"] + """) c ON s.company = c.company"""

ORACLE["read_rules"] = with_(TB, RULES) + "SELECT sheet, cell, accts, ops, items FROM rules"

ORACLE["project_named"] = with_(TB, RULES) + "SELECT cell, accts, ops, items FROM rules"
ORACLE["coalesce_zero"] = ORACLE["cell_amounts"]
ORACLE["ledger_to_cells_dynamic"] = ORACLE["place_dynamic"]
ORACLE["ingest_balances"] = ORACLE["scan_many"]
ORACLE["ingest_statements"] = ORACLE["read_statement_ranges"]
ORACLE["ingest_group"] = with_(TB, BAL_B) + """
SELECT company, acct_code, acct_name, currency, CAST(fc_opening AS DOUBLE) AS fc_opening, CAST(fc_debit AS DOUBLE) AS fc_debit,
 CAST(fc_credit AS DOUBLE) AS fc_credit, CAST(fc_closing AS DOUBLE) AS fc_closing FROM bal_b"""

ORACLE["rule_rejects"] = with_(TB, RULES) + """
SELECT sheet, cell, accts, ops, items, 'pipe lists of unequal length or missing field' AS reason
FROM rules
WHERE accts LIKE '%|%'
  AND (cell IS NULL OR ops IS NULL OR items IS NULL
       OR len(string_split(replace(accts, chr(10), ''), '|')) <> len(string_split(replace(ops, chr(10), ''), '|'))
       OR len(string_split(replace(accts, chr(10), ''), '|')) <> len(string_split(replace(items, chr(10), ''), '|')))"""

ORACLE["batch_tb_to_cells"] = BASE_A[:-1] + ",\n" + SCOPE.strip() + """
, sc AS (SELECT report_name AS company, concat(CAST(serial AS VARCHAR), '-', company, '2024.xlsx') AS paper, fx_flag
         FROM scope)
, fx AS (SELECT DISTINCT company FROM sc WHERE fx_flag IS NOT DISTINCT FROM '是')
, ent_rates AS (SELECT f.company, r.sheet, r.rate FROM fx f CROSS JOIN rates r)
, comp AS (SELECT DISTINCT company FROM long_a WHERE company IN (SELECT company FROM sc))
, per_company AS (SELECT c.company, p.* FROM comp c CROSS JOIN parts p)
, cells0 AS (
 SELECT a.company, a.sheet, a.cell, round(sum(b.amount * a.sign), 2) AS amt
 FROM per_company a LEFT JOIN long_a b
  ON a.company = b.company AND a.acct_code = b.acct_code AND a.item = b.item
 GROUP BY a.company, a.sheet, a.cell)
, cells_rate AS (
 SELECT c.company, c.sheet, c.cell,
  CAST(round(CAST(coalesce(c.amt, 0) AS DECIMAL(18,2)) * coalesce(r.rate, CAST(1 AS DECIMAL(10,4))), 2) AS DECIMAL(18,2)) AS amount
 FROM cells0 c LEFT JOIN ent_rates r ON c.company = r.company AND c.sheet = r.sheet)
""" + _zeroed("cells_rate") + """
SELECT s.paper, z.company, z.sheet, z.cell, CAST(z.amount AS DOUBLE) AS amount
FROM zeroed z JOIN sc s ON z.company = s.company"""


def _dyn_step(i: int, src: str) -> str:
    return f"""
, s{i} AS (
 SELECT t.company, CASE WHEN t.row_no >= pp.c{i} THEN t.row_no + coalesce(pp.a{i}, 0) ELSE t.row_no END AS row_no,
  t.col_no, t.value
 FROM {src} t JOIN pp ON t.company = pp.company)
, l{i} AS (
 SELECT * FROM s{i}
 UNION ALL
 SELECT s.company, unnest(generate_series(pp.c{i}, pp.c{i} + pp.a{i} - 1)) AS row_no, s.col_no, s.value
 FROM s{i} s JOIN pp ON s.company = pp.company
 WHERE pp.a{i} > 0 AND s.row_no = pp.c{i} + pp.a{i})"""


ORACLE["dynamic_paper"] = with_(TB, LEDGER, TEMPLATE)[:-1] + _DYN + """
, pp AS (
 SELECT company,
  max(CASE WHEN func_area = '销售费用' THEN copy_row END) AS c0, max(CASE WHEN func_area = '销售费用' THEN rows_added END) AS a0,
  max(CASE WHEN func_area = '管理费用' THEN copy_row END) AS c1, max(CASE WHEN func_area = '管理费用' THEN rows_added END) AS a1,
  max(CASE WHEN func_area = '研发费用' THEN copy_row END) AS c2, max(CASE WHEN func_area = '研发费用' THEN rows_added END) AS a2
 FROM plan GROUP BY company)
, t0 AS (SELECT file_name AS company, CAST(row_no AS BIGINT) AS row_no, CAST(0 AS BIGINT) AS col_no, a AS value
         FROM template WHERE a IS NOT NULL)""" + _dyn_step(0, "t0") + _dyn_step(1, "l0") + _dyn_step(2, "l1") + """
, summ_start AS (SELECT s.*, pl.start_row FROM summary s JOIN plan pl ON s.company = pl.company AND s.func_area = pl.func_area)
, numbered AS (SELECT *, row_number() OVER (PARTITION BY company, func_area ORDER BY gl_text) AS line_no FROM summ_start)
, pc AS (
 SELECT company, CAST(start_row + line_no - 1 AS BIGINT) AS row_no, CAST(2 AS BIGINT) AS col_no, gl_text AS value FROM numbered
 UNION ALL
 SELECT company, CAST(start_row + line_no - 1 AS BIGINT), CAST(4 AS BIGINT), CAST(amount AS VARCHAR) FROM numbered)
SELECT coalesce(l.company, c.company) AS company, coalesce(l.row_no, c.row_no) AS row_no,
 coalesce(l.col_no, c.col_no) AS col_no, CASE WHEN c.company IS NOT NULL THEN c.value ELSE l.value END AS value
FROM l2 l FULL OUTER JOIN pc c ON l.company = c.company AND l.row_no = c.row_no AND l.col_no = c.col_no"""

ORACLE["batch_report_to_cells"] = STMT[:-1] + _GROUP + _PLACE + """
, sc AS (
 SELECT concat(CAST(s.s_suppkey AS VARCHAR), '-', s.s_name, '2024.xlsx') AS paper, s.s_name AS company,
  n.n_regionkey = 1 AS fx
 FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)
SELECT sc.paper, p.company, CASE WHEN sc.fx THEN '原报表USD' ELSE p.sheet END AS sheet, p.cell, CAST(p.amount AS DOUBLE) AS amount
FROM placed_stmt p JOIN sc ON p.company = sc.company"""

from tallyspark.plans import written_oracle  # noqa: E402,F401  (adds its keys)
