"""Sedge: retrieval, metering and corpus processing as Spark DataFrame operators."""
