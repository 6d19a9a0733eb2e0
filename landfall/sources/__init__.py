from landfall.sources.snapshot import (backup_tables, export_summary_csv, read_snapshot,
                                       read_table, write_snapshot)

__all__ = ["backup_tables", "export_summary_csv", "read_snapshot", "read_table", "write_snapshot"]
