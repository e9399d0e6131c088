"""Training-data operators on Spark DataFrames.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
in :mod:`isoreach.llm.registry` list the registered queries.
"""
