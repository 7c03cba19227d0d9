"""A PySpark-native engine for density-stratified clustering and its evaluation."""

__version__ = "0.1.0"
