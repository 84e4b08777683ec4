"""Scans, sinks and column contracts."""

from .tables import load_table, TABLES
from .csv import scan_csv, sink_csv, sink_tsv
from .lines import scan_lines
from .aligned import numbered_lines, zip_files
from .append import AppendSource, append_rows, appended_epochs, read_appended
from .contracts import require_columns

__all__ = ["load_table", "TABLES", "scan_csv", "sink_csv", "sink_tsv", "scan_lines", "numbered_lines", "zip_files",
           "AppendSource", "append_rows", "appended_epochs", "read_appended", "require_columns"]
