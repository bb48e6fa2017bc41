"""glosswork: annotated-text processing as Spark DataFrame transformations."""

__version__ = "0.1.0"
