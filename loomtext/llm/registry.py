"""What the entry module adds when this subpackage is present."""

from __future__ import annotations

from . import queries as q


def queries() -> dict:
    import corpus_pipeline

    return q.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return q.ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
