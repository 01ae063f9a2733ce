"""folioflow: a document dataflow engine on Spark DataFrames."""

__version__ = "0.1.0"
