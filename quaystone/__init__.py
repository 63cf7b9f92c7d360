"""Linkage, validation and reporting on PySpark DataFrames."""
