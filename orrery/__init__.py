"""Orrery: uncertain entity resolution and corpus analytics on PySpark."""
