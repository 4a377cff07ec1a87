"""windrow: a batch data-exchange and analytics engine on the public PySpark API."""

__version__ = "0.1.0"
