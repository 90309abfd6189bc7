"""Coffer: a PySpark engine for personal-finance transaction data."""
