"""Operators for building language-model training data.

Nothing outside this subpackage imports it.  Each operator lives in its own
module; ``queries.py`` wires them to the given tables.
"""
