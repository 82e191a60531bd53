"""Retail sales analytics as distributed Spark DataFrame jobs."""

from tallybook.model import RetailTables

__all__ = ["RetailTables"]
