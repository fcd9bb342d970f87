"""Hustings: electoral-geography analytics as Spark DataFrame plans."""

__all__ = ["__version__"]
__version__ = "0.1.0"
