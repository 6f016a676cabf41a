"""Table profiling and exploration on Spark."""

from tableassay.plans.profile import Profile, complete_analysis, profile_report, target_analysis, target_report
from tableassay.plans.sql import run_sql
from tableassay.sources.auto import load_auto
from tableassay.sources.catalog import explore_database, sample_rows
from tableassay.sources.files import read_csv, read_json, read_parquet
from tableassay.sources.jdbc import read_bigquery, read_jdbc, read_mysql, read_postgresql
from tableassay.sources.sinks import add_row_key, write_report, write_table
from tableassay.sources.sqlite import list_tables, read_sqlite_query, read_sqlite_table, write_sqlite
from tableassay.sources.workbook import read_excel

__all__ = [
    "Profile",
    "add_row_key",
    "complete_analysis",
    "explore_database",
    "list_tables",
    "load_auto",
    "profile_report",
    "read_bigquery",
    "read_csv",
    "read_excel",
    "read_jdbc",
    "read_json",
    "read_mysql",
    "read_parquet",
    "read_postgresql",
    "read_sqlite_query",
    "read_sqlite_table",
    "run_sql",
    "sample_rows",
    "target_analysis",
    "target_report",
    "write_report",
    "write_sqlite",
    "write_table",
]
