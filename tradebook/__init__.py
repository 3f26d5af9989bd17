"""Business records, page extraction, result ranking and operational events on PySpark."""

__version__ = "0.1.0"
