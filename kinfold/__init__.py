"""Person-record fusion and corpus operators on Spark DataFrames."""

__version__ = "0.2.0"
