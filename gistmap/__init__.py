"""gistmap: topic maps of large chat collections, as Spark DataFrame plans."""

__version__ = "0.1.0"
