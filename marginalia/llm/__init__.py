"""Operators of a training-data pipeline.

Nothing outside this folder imports it; ``queries`` and ``oracle_sql`` of
:mod:`marginalia.llm.registry` are what the entry point adds.
"""
