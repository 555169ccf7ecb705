"""Operators for building large training corpora.

``queries.queries()`` and ``queries.oracle_sql()`` list the registered queries. Nothing outside this
subpackage imports it, apart from the guarded import in ``__spark_entry__.py``.
"""
