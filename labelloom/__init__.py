"""Labelloom: drug-label evidence analytics and data preparation on PySpark."""
