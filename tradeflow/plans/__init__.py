from .oracle import oracle_sql
from .queries import queries

__all__ = ["oracle_sql", "queries"]
