"""Quarrystone: layered analytics pipelines expressed as plain Spark plans."""

__version__ = "0.1.0"
