"""Tree-stem point-cloud analytics as Spark plans."""

__version__ = "0.2.0"
