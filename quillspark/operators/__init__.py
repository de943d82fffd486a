"""Operators over corpora: DataFrames of (scan_index, path, content)."""
