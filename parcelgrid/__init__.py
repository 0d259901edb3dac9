"""Land-footprint analytics as PySpark DataFrame operators and jobs."""

__version__ = "0.1.0"
