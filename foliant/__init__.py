"""Foliant: fleets of documents, their edit histories and their training-data
derivatives, as Spark DataFrames."""

__version__ = "0.1.0"
