"""Spark-native metadata search, normalization and corpus preparation.

Everything is a function from DataFrames to a DataFrame; nothing here keeps
state outside the session except tables written below ``spark.checkpoint.dir``.
"""

__version__ = "0.1.0"
