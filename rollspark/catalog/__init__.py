"""Registered queries: each operator run over whole driver tables, with an
equivalent SQL text for an independent engine (DuckDB) where one exists."""

from rollspark.catalog.core import QUERIES, ORACLE  # noqa: F401


def load_all():
    # importing the modules fills QUERIES / ORACLE
    from rollspark.catalog import (  # noqa: F401
        advantages, answers, batching, curate, distill, extensions, grade_sql, grade_text, losses, metrics, parts, preference, reports, retrieve, select, sequences, shaping, sources, streaming,
    )
    sources.register_late()
    return QUERIES, ORACLE
