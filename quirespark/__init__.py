"""Document analytics for publication corpora, written for Spark DataFrames."""

__version__ = "0.1.0"
