"""Quirefold: positioned-text extraction and text-table operators as lazy Spark DataFrame plans."""
