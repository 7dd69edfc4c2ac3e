"""treeparity: compare data trees (or any relation shaped like one) as Spark DataFrames."""

__version__ = "0.1.0"
