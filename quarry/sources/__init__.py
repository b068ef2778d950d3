"""Input tables."""

from quarry.sources.tables import TABLES, read_table, table_path

__all__ = ["TABLES", "read_table", "table_path"]
