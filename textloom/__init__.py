"""textloom: text-corpus analytics, retrieval preparation and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
