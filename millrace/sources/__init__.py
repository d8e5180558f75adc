"""Reading the input tables."""

from millrace.sources.tables import SCHEMAS, read_table, read_tables

__all__ = ["SCHEMAS", "read_table", "read_tables"]
