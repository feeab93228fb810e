"""Operators for training-data corpora, each with its registered query.

Nothing outside this folder imports it. ``queries`` has the registered queries and their SQL.
"""
