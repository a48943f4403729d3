"""Whole audits, derived test tables and the query catalogue."""
