"""Operators of a training-data pipeline: filters, tokens, classifiers, sketches, joins, mixing and archives."""
