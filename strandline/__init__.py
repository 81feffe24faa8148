"""Strandline: provenance analytics over software and document collections, on Spark DataFrames."""

__version__ = "0.1.0"
