"""Operators for preparing training text: ten corpus-scale Spark jobs."""
