"""marchland: boundary-aware clustering of points and the data preparation around it, on Spark DataFrames."""

__version__ = "0.1.0"
