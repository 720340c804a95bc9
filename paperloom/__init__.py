"""paperloom: literature and vocabulary curation on Spark DataFrames."""

__version__ = "0.1.0"
