"""Verdant: time-series analytics for gridded sensor archives on PySpark."""
