from rowassay.sources.scan import normalize_types, scan_table, scan_tables

__all__ = ["normalize_types", "scan_table", "scan_tables"]
