"""Reading raw tables and keeping confirmed ones."""

from tabwright.sources.delimited import RawTable, read_delimited
from tabwright.sources.headers import clean_names, drop_placeholders
from tabwright.sources.tables import cap_rows, preview, read_table, save_table, stored_specs, with_row_id

__all__ = [
    "RawTable", "cap_rows", "clean_names", "drop_placeholders", "preview", "read_delimited",
    "read_table", "save_table", "stored_specs", "with_row_id",
]
