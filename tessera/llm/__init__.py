"""Operators of training-data pipelines: search, dedup, joins, classifiers, tokens, archives, scans."""
