"""Spark-first analytics over conversational and document memory."""

__version__ = "0.1.0"
