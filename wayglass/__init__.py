"""Wayglass: observation analytics written as Spark DataFrame transformations."""
