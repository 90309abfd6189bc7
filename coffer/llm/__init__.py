"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it; ``queries.py`` registers the
operators for the driver.
"""
