"""Readers: parquet tables of a data directory and the text, binary and feed formats of the catalogues."""

from strandline.sources.tables import table

__all__ = ["table"]
