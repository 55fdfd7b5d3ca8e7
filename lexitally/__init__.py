"""Word-frequency analytics for XML dumps and text tables, as Spark DataFrames."""

__version__ = "0.1.0"
