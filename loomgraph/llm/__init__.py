"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``queries()`` and ``oracle_sql()`` of
:mod:`loomgraph.llm.registry` are what the driver entry adds.
"""
