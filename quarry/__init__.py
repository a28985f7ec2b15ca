"""quarry: text search and corpus processing as Spark DataFrame plans."""

__version__ = "0.1.0"
