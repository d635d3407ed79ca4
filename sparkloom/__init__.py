"""sparkloom: a Spark-first engine for catalogue analytics."""

__version__ = "0.1.0"
