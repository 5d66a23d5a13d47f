from .panel import (
    check_contract, current_version, load_panel, read_table, read_year_files, replace_table, require_columns, require_rows,
    require_unique_key, store_by_series, with_contract, write_by_year, write_table,
)
from .staging import scratch_folder, staged, staging_scope

__all__ = [
    "check_contract", "current_version", "load_panel", "read_table", "read_year_files", "replace_table", "require_columns",
    "require_rows", "require_unique_key", "store_by_series", "with_contract", "write_by_year", "write_table", "scratch_folder", "staged", "staging_scope",
]
