"""Trial-balance and working-paper analytics as Spark jobs.

Every flow takes DataFrames keyed by ``company`` (or ``file_name``) and returns
DataFrames, so one run covers a whole group of companies. The main flows:

    from tallyspark import (ingest_workbooks, sheet_rows, tb_to_cells, statements_to_cells,
                            ledger_to_cells, counterparty_tables, expense_tables)
"""

from tallyspark.session import cluster_conf, ensure_checkpoint_dir, get_spark  # noqa: F401
from tallyspark.sources.xlsx import ingest_workbooks, scan_workbook_cells, sheet_rows  # noqa: F401
from tallyspark.plans.jobs import (batch_entities, batch_report_to_cells, batch_tb_to_cells,  # noqa: F401
                                   ingest_balances, ingest_group, ingest_statements, ledger_to_cells,
                                   ledger_to_cells_dynamic, pair_files, report_to_cells, split_ledger,
                                   statements_to_cells, tb_to_cells)
from tallyspark.operators.counterparty import extract_all as counterparty_tables  # noqa: F401
from tallyspark.operators.papers import read_ranges as expense_tables  # noqa: F401

__all__ = [
    "get_spark", "ensure_checkpoint_dir", "cluster_conf",
    "ingest_workbooks", "scan_workbook_cells", "sheet_rows",
    "tb_to_cells", "batch_tb_to_cells", "statements_to_cells", "report_to_cells", "batch_report_to_cells",
    "ledger_to_cells", "ledger_to_cells_dynamic", "batch_entities", "split_ledger", "pair_files",
    "ingest_balances", "ingest_statements", "ingest_group", "counterparty_tables", "expense_tables",
]
