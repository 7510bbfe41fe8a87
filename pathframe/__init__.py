"""PathFrame: a declarative path-and-transform expression engine on PySpark."""

__version__ = "0.1.0"
