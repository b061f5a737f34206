"""Operators for preparing large text corpora, one module per operator.

Nothing else in the library imports this subpackage. Queries over the shared tables are in
``queries``, their DuckDB counterparts in ``oracle``.
"""
