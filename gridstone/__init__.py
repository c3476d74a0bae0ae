"""gridstone: dense grids, point sets, signals, sparse matrices and graphs as Spark DataFrames."""

__version__ = "0.1.0"
