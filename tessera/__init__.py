"""tessera: cross-lingual topic-cluster mining on Spark DataFrames."""

__version__ = "0.1.0"
