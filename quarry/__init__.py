"""A document retrieval and data-processing engine that runs as Spark plans."""

__version__ = "0.1.0"
