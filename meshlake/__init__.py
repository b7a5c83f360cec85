"""meshlake: gridded array datasets and redistribution plans on Spark DataFrames."""

__version__ = "0.1.0"
