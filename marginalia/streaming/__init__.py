"""Audits of papers that keep arriving."""
