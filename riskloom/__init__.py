"""riskloom: a PySpark-native risk-findings engine for source trees."""

__version__ = "0.1.0"
