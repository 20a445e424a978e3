"""Operators of a training-data pipeline on texts, vectors and samples. Nothing else in wafergrid imports this package."""
