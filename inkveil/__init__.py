"""inkveil: find and reversibly replace confidential values in text with Spark DataFrames."""

__version__ = "0.1.0"
