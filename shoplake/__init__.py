"""shoplake: an order lakehouse expressed as Spark DataFrame and streaming jobs."""

__version__ = "0.1.0"
