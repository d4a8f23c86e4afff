"""Attribute-value canonicalization as Spark DataFrame transformations."""
