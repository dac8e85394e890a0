"""feedwright: PySpark jobs that recompute what a data feed should hold and report where it differs."""

__version__ = "0.1.0"
